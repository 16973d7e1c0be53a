"""Rings, counter mode and residues against published vectors and plain Python."""

import math
import random

from pyspark.sql import functions as F

from cipherlake.functions import modes, residues, rings


def schoolbook(a, b):
    out = [0] * 256
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[(i + j) % 256] += x * y if i + j < 256 else -x * y
    return [c % 3329 for c in out]


def test_products_equal_the_schoolbook(spark):
    draw = random.Random(3)
    rows = [([draw.randrange(3329) for _ in range(256)], [draw.randrange(3329) for _ in range(256)]) for _ in range(3)] + [([3328] * 256, [3328] * 256)]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", rings.product(F.col("a"), F.col("b")).alias("c"), rings.inverse_ntt(rings.ntt(F.col("a"))).alias("same")).collect()
    assert len(got) == 4
    for r in got:
        assert r.c == schoolbook(r.a, r.b) and r.same == r.a


def test_noise_and_packing(spark):
    draw = random.Random(4)
    data = [draw.randrange(256) for _ in range(192)]
    f = [draw.randrange(3329) for _ in range(256)]
    df = spark.createDataFrame([(data, f)], "d array<long>, f array<long>")
    r = df.select(rings.noise(F.col("d"), 3).alias("n"), rings.packed(F.col("f"), 12).alias("p"), rings.unpacked(rings.packed(F.col("f"), 12), 12).alias("u"), rings.compressed(F.col("f"), 4).alias("c"), rings.decompressed(rings.compressed(F.col("f"), 10), 10).alias("e")).first()
    bits = [b >> k & 1 for b in data for k in range(8)]
    assert r.n == [(sum(bits[6 * i : 6 * i + 3]) - sum(bits[6 * i + 3 : 6 * i + 6])) % 3329 for i in range(256)]
    whole = sum(c << 12 * i for i, c in enumerate(f))
    assert bytes(r.p) == whole.to_bytes(384, "little") and r.u == f
    assert r.c == [math.floor(x * 16 / 3329 + 0.5) % 16 for x in f]
    assert all(min(abs(x - y), 3329 - abs(x - y)) <= 2 for x, y in zip(r.e, f))


def test_counter_mode_vector(spark):
    # NIST SP 800-38A, F.5.1
    key, nonce, first = "2b7e151628aed2a6abf7158809cf4f3c", "f0f1f2f3f4f5f6f7", 0xF8F9FAFBFCFDFEFF - 2**64
    plain = "6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e5130c81c46a35ce411e5fbc1191a0a52eff69f2445df4f9b17ad2b417be66c3710"
    want = "874d6191b620e3261bef6864990db6ce9806f66b7970fdff8617187bb9fffdff5ae4df3edbd5d35e5b4f09020db03eab1e031dda2fbe03d1792170a0f3009cee"
    rows = [(n, plain[: 2 * n]) for n in (64, 33, 16, 8, 7, 1, 0)] + [(-1, None)]
    df = spark.createDataFrame(rows, "n int, plain string").select("n", F.unhex("plain").alias("data"))
    got = {r.n: r.c for r in df.select("n", modes.aes_ctr(F.col("data"), F.unhex(F.lit(key)), F.unhex(F.lit(nonce)), first).alias("c")).collect()}
    assert got.pop(-1) is None
    assert {n: bytes(c).hex() for n, c in got.items()} == {n: want[: 2 * n] for n in got}


def plain_jacobi(a, n):
    out, p = 1, 3
    while n > 1:
        while n % p == 0:
            n //= p
            s = pow(a, (p - 1) // 2, p)
            out *= -1 if s == p - 1 else s
        p += 2
    return out


def test_jacobi_and_inverses(spark):
    draw = random.Random(6)
    rows = [(draw.randrange(-10_000, 10_000), draw.randrange(1, 5_000) * 2 + 1) for _ in range(300)] + [(7, 1), (0, 9), (0, 1), (2**40 + 1, 2**31 - 1), (5, 8), (5, 0)]
    for r in spark.createDataFrame(rows, "a long, n long").select("a", "n", residues.jacobi(F.col("a"), F.col("n")).alias("j"), F.when(F.col("n") > 1, residues.inverse(F.col("a"), F.col("n"))).alias("i")).collect():
        if r.n % 2 == 1 and r.n < 2**20:
            assert r.j == plain_jacobi(r.a, r.n), r
        elif r.n % 2 == 0:
            assert r.j is None
        if r.n > 1:
            assert r.i == (pow(r.a, -1, r.n) if math.gcd(r.a, r.n) == 1 else None), r


def test_congruences_wider_than_a_long(spark):
    primes = [2147483647, 2147483629, 2147483587, 2147483579]
    x = 10**36 + 12345
    rows = [([x % p for p in primes], primes), ([2, 3], [3, 5]), ([1, 1], [4, 6]), ([], [])]
    got = [r.x for r in spark.createDataFrame(rows, "r array<long>, m array<long>").select(residues.crt(F.col("r"), F.col("m")).alias("x")).collect()]
    assert [None if v is None else int(v) for v in got] == [x, 8, None, 0]


def test_powers_and_orders(spark):
    rows = [(4,), (8,), (64,), (1,), (0,), (7,), (3**30,), (3**30 + 1,), (94906265**2,), (2**52,)]
    got = {r.n: r.p and tuple(r.p) for r in spark.createDataFrame(rows, "n long").select("n", residues.perfect_power(F.col("n")).alias("p")).collect()}
    assert got == {4: (2, 2), 8: (2, 3), 64: (2, 6), 1: None, 0: None, 7: None, 3**30: (3, 30), 3**30 + 1: None, 94906265**2: (94906265, 2), 2**52: (2, 52)}
    orders = spark.createDataFrame([(7, 4, 15), (14, 2, 15), (2, 3, 7)], "a long, o long, n long")
    assert [r.f for r in orders.select(residues.factor_of_order(F.col("a"), F.col("o"), F.col("n")).alias("f")).collect()] == [3, None, None]
