"""Polynomials modulo x**256 + 1 and 3329 as array columns: number-theoretic transform, products, noise and packing (FIPS 203), inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

N, Q, ROOT = 256, 3329, 17


def _reversed(i: int) -> int:
    return int(f"{i:07b}"[::-1], 2)


def _literal(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with value computed once, however often it is used."""
    return F.transform(F.array(value), of)[0]


def _each(n: int, of: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), of)


def _layer(bits: int, inverse: bool) -> Callable[[Column], Column]:
    """Butterflies over 2**bits places: each place reads its partner, so a layer is one pass over the array."""
    width, blocks = 1 << bits, N >> (bits + 1)
    order = range(2 * blocks - 1, blocks - 1, -1) if inverse else range(blocks, 2 * blocks)
    zeta = _literal([pow(ROOT, _reversed(k), Q) for k in order])

    def place(f: Column, i: Column) -> Column:
        z, own, upper = F.get(zeta, F.shiftright(i, bits + 1)), F.get(f, i), i.bitwiseAND(width) > 0
        low, high = F.get(f, i - width), F.get(f, i + width)
        if inverse:
            return F.when(upper, F.pmod(z * (own - low), F.lit(Q))).otherwise((own + high) % Q)
        return F.when(upper, F.pmod(low - z * own, F.lit(Q))).otherwise((own + z * high) % Q)

    return lambda f: _each(N, lambda i: place(f, i))


def ntt(f: Column) -> Column:
    """The transform of 256 coefficients from 0 to 3328: 128 residues of degree one."""
    for bits in range(7, 0, -1):
        f = _bound(f, _layer(bits, False))
    return f


def inverse_ntt(f: Column) -> Column:
    for bits in range(1, 8):
        f = _bound(f, _layer(bits, True))
    return F.transform(f, lambda x: x * pow(128, -1, Q) % Q)


def pairwise(a: Column, b: Column) -> Column:
    """Products of transformed polynomials, residue by residue."""
    gamma = _literal([pow(ROOT, 2 * _reversed(i) + 1, Q) for i in range(N // 2)])

    def place(i: Column, x: Column, y: Column) -> Column:
        even = i - i % 2
        a0, a1, b0, b1 = F.get(x, even), F.get(x, even + 1), F.get(y, even), F.get(y, even + 1)
        return F.when(i % 2 == 0, (a0 * b0 + a1 * b1 % Q * F.get(gamma, F.shiftright(i, 1))) % Q).otherwise((a0 * b1 + a1 * b0) % Q)

    return _bound(a, lambda x: _bound(b, lambda y: _each(N, lambda i: place(i, x, y))))


def product(a: Column, b: Column) -> Column:
    """a * b modulo x**256 + 1."""
    return inverse_ntt(pairwise(ntt(a), ntt(b)))


def _bits_from(values: Column, first: Column, n: int, width: int) -> list[Column]:
    """Bits first to first + n of values of `width` bits each, lowest first."""
    out = []
    for k in range(n):
        at = first + k
        out.append(F.floor(F.get(values, F.floor(at / width).cast("int")) / F.pow(F.lit(2.0), at % width)).cast("long") % 2)
    return out


def noise(data: Column, eta: int) -> Column:
    """256 centred binomial coefficients of 64 * eta bytes (an array of byte values): eta bits less the next eta."""

    def one(i: Column) -> Column:
        bits = _bits_from(data, i * (2 * eta), 2 * eta, 8)
        return F.pmod(sum(bits[1:eta], bits[0]) - sum(bits[eta + 1 :], bits[eta]), F.lit(Q))

    return _each(N, one)


def packed(f: Column, width: int) -> Column:
    """Coefficients of `width` bits as an array of byte values."""
    return _each(N * width // 8, lambda j: sum(b * (1 << k) for k, b in enumerate(_bits_from(f, j * 8, 8, width))))


def unpacked(data: Column, width: int) -> Column:
    """The coefficients of packed(), modulo 3329 at 12 bits."""
    return _each(N, lambda i: sum(b * (1 << k) for k, b in enumerate(_bits_from(data, i * width, width, 8))) % (Q if width == 12 else 1 << width))


def compressed(f: Column, width: int) -> Column:
    """Coefficients rounded to `width` bits."""
    return F.transform(f, lambda x: F.floor((x * (2 << width) + Q) / (2 * Q)).cast("long") % (1 << width))


def decompressed(f: Column, width: int) -> Column:
    return F.transform(f, lambda x: F.floor((x * (2 * Q) + (1 << width)) / (2 << width)).cast("long"))
