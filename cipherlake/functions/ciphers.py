"""Text attacks, digests and number functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shares of English letters in per cent, and the weight of a blank.
FREQUENCIES = {
    "a": 8.167, "b": 1.492, "c": 2.782, "d": 4.253, "e": 12.702, "f": 2.228, "g": 2.015, "h": 6.094, "i": 6.966, "j": 0.153, "k": 0.772, "l": 4.025, "m": 2.406, "n": 6.749, "o": 7.507, "p": 1.929, "q": 0.095, "r": 5.987, "s": 6.327, "t": 9.056, "u": 2.758, "v": 0.978, "w": 2.361, "x": 0.150, "y": 1.974, "z": 0.074, " ": 13.0,
}
#: Scores are sums of thousandths, so that they are the same in any order.
WEIGHTS = [round(1000 * FREQUENCIES[chr(b).lower()]) if chr(b).lower() in FREQUENCIES else 500 if 32 <= b <= 126 else -10_000 for b in range(256)]


def _hex(text: Column) -> Column:
    return F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def text_bytes(text: Column) -> Column:
    """Array of the UTF-8 bytes of a text (null: none), cut from its hexadecimal form in one pass."""
    return F.transform(F.regexp_extract_all(_hex(text), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))


def repeated_text_blocks(text: Column, size: int = 16) -> Column:
    """Whether two whole blocks of `size` bytes of a text are equal."""
    blocks = F.regexp_extract_all(_hex(text), F.lit(f".{{{2 * size}}}"), F.lit(0))
    return F.size(F.array_distinct(blocks)) < F.size(blocks)


def english_score(text: Column) -> Column:
    """Thousandths of the English score of a text's bytes: letter shares, half a point for other printable bytes, minus ten for the rest.

    Letters are counted by what is missing once they are taken out: a few passes of built-in functions, no byte arrays.
    """
    whole = F.coalesce(text, F.lit(""))
    t = F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = {c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in FREQUENCIES}
    printable = F.length(F.regexp_replace(t, r"[^\x20-\x7e]", ""))
    score = sum((n * round(1000 * FREQUENCIES[c]) for c, n in counts.items()), F.lit(0).cast("long"))
    return score + (printable - sum(counts.values(), F.lit(0))) * 500 - (F.octet_length(whole) - printable).cast("long") * 10_000


def best_single_byte(rows: DataFrame, key: str, data: str) -> DataFrame:
    """(key, byte, score) of rows (key, data: array of bytes): the byte whose xor gives the best English score, the lowest of equals.

    Bytes are counted first, so a row has at most 256 x 256 products of a count and a weight, however
    long it is; rows without bytes get byte 0 and score 0.
    """
    table = F.array(*map(F.lit, WEIGHTS))
    counts = rows.select(key, F.explode(data).alias("v")).groupBy(key, "v").agg(F.count("*").alias("n"))
    tried = counts.withColumn("byte", F.explode(F.sequence(F.lit(0), F.lit(255))))
    scored = tried.groupBy(key, "byte").agg(F.sum(F.col("n") * F.get(table, F.col("v").bitwiseXOR(F.col("byte")))).alias("score"))
    best = scored.groupBy(key).agg(F.max(F.struct("score", (-F.col("byte")).alias("minus"))).alias("b"))
    return rows.select(key).join(best, key, "left").select(key, F.coalesce(-F.col("b.minus"), F.lit(0)).cast("long").alias("byte"), F.coalesce("b.score", F.lit(0)).cast("long").alias("score"))


def key_sizes(data: Column, least: int = 2, most: int = 40, keep: int = 3) -> Column:
    """The `keep` key sizes with the smallest mean Hamming distance a byte between the first four blocks, smallest first.

    Sizes go up to a quarter of the data, exclusive. Distances are compared in millionths; ties go to
    the smaller size.
    """

    def distance(size: Column, i: int, j: int) -> Column:
        a, b = F.slice(data, size * i + 1, size), F.slice(data, size * j + 1, size)
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)

    def mean(size: Column) -> Column:
        total = sum((distance(size, i, j) for i in range(4) for j in range(i + 1, 4)), F.lit(0))
        return F.floor(total.cast("double") / size * 1_000_000 + 0.5).cast("long")

    top = F.least(F.lit(most), F.floor(F.size(data) / 4).cast("int") - 1)
    sizes = F.when(top >= least, F.sequence(F.lit(least), F.greatest(top, F.lit(least)))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.slice(F.array_sort(F.transform(sizes, lambda s: F.struct(mean(s).alias("d"), s.alias("size")))), 1, keep), lambda x: x["size"])


def hex_to_base64(hexadecimal: Column) -> Column:
    return F.base64(F.unhex(hexadecimal))


def hmac_sha256(key: Column, text: Column) -> Column:
    """HMAC of a text with a key of at most 64 bytes (UTF-8), in lower-case hexadecimal."""
    padded = F.rpad(F.hex(F.encode(key, "UTF-8")), 128, "0")
    mixed = lambda pad: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.conv(F.substring(padded, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(pad))), 2, "0")), "")
    inner = F.sha2(F.unhex(F.concat(mixed(0x36), F.hex(F.encode(text, "UTF-8")))), 256)
    return F.sha2(F.unhex(F.concat(mixed(0x5C), inner)), 256)


def merkle_roots(blocks: DataFrame) -> DataFrame:
    """(tree, root) of (tree, pos, text): SHA-256 of each block, then of pairs of neighbours, level by level, the last of an odd level twice.

    A level is one aggregation by (tree, half the position), so a tree of any size is spread over all
    tasks; the number of levels is that of the largest tree.
    """
    level = blocks.select("tree", F.col("pos").alias("at"), F.sha2(F.encode("text", "UTF-8"), 256).alias("h"))
    most = level.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while most > 1:
        # Lone roots of smaller trees stay as they are.
        size = level.groupBy("tree").agg(F.count("*").alias("n"))
        pair = level.join(size, "tree").groupBy("tree", "n", F.floor(F.col("at") / 2).alias("at")).agg(F.max_by("h", "at").alias("r"), F.min_by("h", "at").alias("first"))
        level = pair.select("tree", "at", F.when(F.col("n") == 1, F.col("first")).otherwise(F.sha2(F.unhex(F.concat("first", "r")), 256)).alias("h"))
        most = -(-most // 2)
    return level.select("tree", F.col("h").alias("root"))


def gcd(a: Column, b: Column, steps: int = 92) -> Column:
    """Greatest common divisor of two non-negative longs, by remainders; 92 steps are enough for any long."""
    state = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))))
    return state["a"]


def power_mod(base: Column, exponent: Column, modulus: Column) -> Column:
    """base ** exponent mod modulus for moduli below 2**31, bit by bit."""
    start = F.struct((base % modulus).cast("long").alias("b"), exponent.cast("long").alias("e"), (F.lit(1).cast("long") % modulus).cast("long").alias("r"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, lambda s, _: F.struct((s["b"] * s["b"] % modulus).alias("b"), F.shiftright(s["e"], 1).alias("e"), F.when(s["e"] % 2 == 1, s["r"] * s["b"] % modulus).otherwise(s["r"]).alias("r")))
    return done["r"]


def inverse_mod(a: Column, modulus: Column) -> Column:
    """The inverse by a prime modulus below 2**31 (Fermat); null for 0."""
    return F.when(a % modulus != 0, power_mod(a, modulus - 2, modulus))


def is_prime(n: Column) -> Column:
    """Primality of integers below 2**31: strong tests to the bases 2, 3, 5 and 7, which decide there."""
    odd = F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.struct((n - 1).cast("long").alias("d"), F.lit(0).alias("s")), lambda x, _: F.when((x["d"] > 0) & (x["d"] % 2 == 0), F.struct(F.floor(x["d"] / 2).cast("long").alias("d"), (x["s"] + 1).alias("s"))).otherwise(x))

    def strong(base: int) -> Column:
        x = power_mod(F.lit(base).cast("long"), odd["d"], F.greatest(n, F.lit(2)).cast("long"))
        steps = F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.struct(x.alias("x"), ((x == 1) | (x == n - 1)).alias("ok"), F.lit(1).alias("k")), lambda t, _: F.struct((t["x"] * t["x"] % F.greatest(n, F.lit(2))).alias("x"), (t["ok"] | ((t["k"] < odd["s"]) & (t["x"] * t["x"] % F.greatest(n, F.lit(2)) == n - 1))).alias("ok"), (t["k"] + 1).alias("k")))
        return (n == base) | ((n % base != 0) & steps["ok"])

    return (n > 1) & strong(2) & strong(3) & strong(5) & strong(7)


def order_mod(a: Column, modulus: Column, most: int = 4096) -> Column:
    """The multiplicative order of a for moduli up to `most`: the first power that is 1; null without one."""
    powers = F.aggregate(F.sequence(F.lit(1), modulus.cast("int")), F.struct(F.lit(1).cast("long").alias("x"), F.lit(None).cast("int").alias("at")), lambda s, k: F.struct((s["x"] * a % modulus).cast("long").alias("x"), F.coalesce(s["at"], F.when(s["x"] * a % modulus == 1, k)).alias("at")))
    return F.when((modulus > 1) & (modulus <= most), powers["at"])


def factors(numbers: DataFrame) -> DataFrame:
    """(n, factors): prime factors of longs in ascending order, by trial division and Pollard's rho, in Arrow batches."""

    def split(n: int) -> list[int]:
        out = []
        for p in (2, 3, 5, 7, 11, 13):
            while n > 1 and n % p == 0:
                out.append(p)
                n //= p
        stack = [n] if n > 1 else []
        while stack:
            m = stack.pop()
            if _prime(m):
                out.append(m)
                continue
            d = _divisor(m)
            stack += [d, m // d]
        return sorted(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array([split(x) if x and x > 0 else None for x in n], pa.list_(pa.int64()))], names=["n", "factors"])

    return numbers.select(F.col("n").cast("long").alias("n")).mapInArrow(run, "n long, factors array<long>")


def _prime(n: int) -> bool:
    if n < 2:
        return False
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):  # enough below 2**64
        if n % a == 0:
            return n == a
        x = pow(a, d, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def _divisor(n: int) -> int:
    """A proper divisor of an odd composite number: Floyd's cycle with growing constants."""
    from math import gcd as common

    for c in range(1, n):
        x = y = 2
        d = 1
        while d == 1:
            x = (x * x + c) % n
            y = (y * y + c) % n
            y = (y * y + c) % n
            d = common(abs(x - y), n)
        if d != n:
            return d
    raise ValueError("no divisor")
