"""Counter mode over AES blocks: Spark has ECB, CBC and GCM; the key stream is the ECB text of the counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _words(data: Column, n: Column) -> Column:
    """n words of 64 bits; data are bound once and cut as bytes, so a word costs the same at any place."""
    return F.transform(F.array(data), lambda d: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.hex(F.substring(d, i * 8 + 1, F.lit(8))), 16, -10).cast("long")))[0]


def aes_ctr(data: Column, key: Column, nonce: Column, first: Column | int = 0) -> Column:
    """data xored with the key stream; the same call decrypts. Empty data stay empty, null gives null.

    A counter block is the nonce (8 bytes) and a 64-bit big-endian number from `first` on. All of a
    row's blocks go through one call, and bytes are xored eight at a time.
    """
    first = F.lit(first).cast("long") if isinstance(first, int) else first
    n = F.ceil(F.length(data) / 16).cast("int")
    counters = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.hex(nonce), F.lpad(F.hex(first + i), 16, "0"))), "")
    stream = F.aes_encrypt(F.unhex(counters), key, F.lit("ECB"), F.lit("PKCS"))
    padded = F.concat(data, F.unhex(F.lit("00" * 15)))
    mixed = F.zip_with(_words(padded, n * 2), _words(stream, n * 2), lambda x, y: F.lpad(F.hex(x.bitwiseXOR(y)), 16, "0"))
    return F.when(n > 0, F.unhex(F.substring(F.array_join(mixed, ""), F.lit(1), F.length(data) * 2))).otherwise(data)
