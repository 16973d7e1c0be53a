"""Residues as columns: Jacobi symbols, congruences, perfect powers and factors from an order, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cipherlake.functions.ciphers import gcd, power_mod

WIDE = "decimal(38,0)"


def _steps(n: Column) -> Column:
    """1 to n, one step at least."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), n))


def _bits(n: Column) -> Column:
    return F.length(F.bin(n.cast("long")))


def jacobi(a: Column, n: Column) -> Column:
    """The Jacobi symbol (a / n) for odd n from 1 to below 2**31; null for other n."""
    start = F.struct(F.pmod(a, n).cast("long").alias("a"), n.cast("long").alias("n"), F.lit(1).alias("t"))

    def step(s: Column, _: Column) -> Column:
        halved = F.struct(F.shiftright(s["a"], 1).alias("a"), s["n"].alias("n"), F.when((s["n"] % 8).isin(3, 5), -s["t"]).otherwise(s["t"]).alias("t"))
        swapped = F.struct((s["n"] % F.when(s["a"] == 0, 1).otherwise(s["a"])).alias("a"), s["a"].alias("n"), F.when((s["a"] % 4 == 3) & (s["n"] % 4 == 3), -s["t"]).otherwise(s["t"]).alias("t"))
        return F.when(s["a"] == 0, s).when(s["a"] % 2 == 0, halved).otherwise(swapped)

    # A step at least halves the product of both numbers.
    done = F.aggregate(_steps(2 * _bits(n)), start, step, lambda s: F.when(s["n"] == 1, s["t"]).otherwise(0))
    return F.when((n > 0) & (n % 2 == 1), done)


def inverse(a: Column, modulus: Column) -> Column:
    """The inverse by any modulus from 2 to below 2**31, by extended division; null without one."""
    start = F.struct(F.pmod(a, modulus).cast("long").alias("r"), modulus.cast("long").alias("next"), F.lit(1).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))

    def step(s: Column, _: Column) -> Column:
        q = F.floor(s["r"] / F.when(s["next"] == 0, 1).otherwise(s["next"])).cast("long")
        return F.when(s["next"] == 0, s).otherwise(F.struct(s["next"].alias("r"), (s["r"] - q * s["next"]).alias("next"), s["y"].alias("x"), (s["x"] - q * s["y"]).alias("y")))

    # Two divisions at least halve a remainder, after one or two that put both numbers in order.
    return F.aggregate(_steps(2 * _bits(modulus) + 2), start, step, lambda s: F.when(s["r"] == 1, F.pmod(s["x"], modulus)))


def crt(remainders: Column, moduli: Column) -> Column:
    """The smallest x >= 0 with x = remainders[i] modulo moduli[i], as decimal(38,0).

    Moduli from 2 to below 2**31 that have no common factor, with a product below 10**38; null otherwise. The fold
    takes one congruence after the other, so only the running solution is wide.
    """
    start = F.struct(F.lit(0).cast(WIDE).alias("x"), F.lit(1).cast(WIDE).alias("m"))

    def step(s: Column, c: Column) -> Column:
        m = c["m"].cast("long")
        gap = F.pmod(c["r"].cast("long") - (s["x"] % m).cast("long"), m)
        k = gap * inverse((s["m"] % m).cast("long"), m) % m
        return F.struct((s["x"] + s["m"] * k.cast("decimal(10,0)")).cast(WIDE).alias("x"), (s["m"] * m.cast("decimal(10,0)")).cast(WIDE).alias("m"))

    pairs = F.zip_with(remainders, moduli, lambda r, m: F.struct(r.alias("r"), m.alias("m")))
    return F.aggregate(pairs, start, step, lambda s: s["x"])


def perfect_power(n: Column) -> Column:
    """(base, exponent) with the largest exponent from 2 on for integers from 4 to below 2**53; null for others."""
    whole = n.cast("double")

    def root(k: Column) -> Column:
        base = F.round(F.pow(whole, 1.0 / k)).cast("long")
        # Powers of whole numbers are exact where a double holds them, and none below 2**53 is left out.
        return F.when((base > 1) & (F.pow(base.cast("double"), k.cast("double")) == whole), F.struct(base.alias("base"), k.alias("exponent")))

    found = F.array_compact(F.transform(F.sequence(F.lit(52), F.lit(2)), root))
    return F.when((n >= 4) & (n < 2**53), F.get(found, F.lit(0)))


def factor_of_order(a: Column, order: Column, n: Column) -> Column:
    """A proper factor of n from the even order of a: gcd(a ** (order / 2) - 1, n), else with + 1; null where neither is one."""
    half = power_mod(a, F.floor(order / 2).cast("long"), n)
    proper = lambda g: F.when((g > 1) & (g < n), g)
    return F.when((order % 2 == 0) & (half != n - 1), F.coalesce(proper(gcd(F.abs(half - 1), n)), proper(gcd(half + 1, n))))
