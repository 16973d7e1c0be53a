"""Bit and text functions for cipher exercises, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_array(hexadecimal: Column) -> Column:
    """Array of the byte values of a hexadecimal text."""
    n = F.floor(F.length(hexadecimal) / 2).cast("int")
    bytes_ = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.conv(F.substring(hexadecimal, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(n > 0, bytes_).otherwise(F.array().cast("array<int>"))


def xor_cycle(data: Column, key: Column) -> Column:
    """Bytes of data xored with the repeated key."""
    return F.transform(data, lambda x, i: x.bitwiseXOR(F.get(key, i % F.size(key))))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two byte arrays, to the length of the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def repeated_blocks(data: Column, size: int = 16) -> Column:
    """Whether two whole blocks of the byte array are equal."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(data) / size).cast("int") - 1, F.lit(0))), lambda i: F.slice(data, i * size + 1, size))
    return (F.size(data) >= 2 * size) & (F.size(F.array_distinct(blocks)) < F.size(blocks))


def unpadded(data: Column, size: int = 16) -> Column:
    """Bytes without their PKCS#7 padding; null where it is invalid."""
    last = F.element_at(data, -1)
    good = (F.size(data) > 0) & (F.size(data) % size == 0) & (last >= 1) & (last <= size)
    tail_ok = F.forall(F.slice(data, F.size(data) - F.least(F.greatest(last, F.lit(1)), F.size(data)) + 1, F.least(F.greatest(last, F.lit(1)), F.size(data))), lambda x: x == last)
    return F.when(good & tail_ok, F.slice(data, 1, F.size(data) - last))


def cipher_suite(name: Column) -> Column:
    """struct(kex, auth, encryption) of a TLS cipher suite name: TLS 1.3 names carry the encryption alone."""
    with_ = F.split(F.regexp_replace(name, "^TLS_", ""), "_WITH_")
    old = F.size(with_) == 2
    parts = F.split(F.get(with_, F.lit(0)), "_")
    kex = F.when(old, F.get(parts, F.lit(0))).otherwise("(EC)DHE")
    auth = F.when(old, F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).otherwise("certificate")
    return F.struct(kex.alias("kex"), auth.alias("auth"), F.element_at(with_, -1).alias("encryption"))


def pqc_groups(groups: Column) -> Column:
    """The groups with a lattice key exchange."""
    return F.filter(groups, lambda g: F.lower(g).rlike("kyber|mlkem"))


def tls_record(header: Column) -> Column:
    """struct(kind, version, length) of the five-byte record header."""
    number = lambda at, n: F.conv(F.hex(F.substring(header, at, n)), 16, 10).cast("int")
    return F.struct(number(1, 1).alias("kind"), F.hex(F.substring(header, 2, 2)).alias("version"), number(4, 2).alias("length"))
