"""Shared helpers of the training-data operators: tables, shared storage, text hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.sources.staging import discard, fresh_path, remove_path, shared_dir, staged  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word pattern: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_parts(spark: SparkSession, size: int) -> int:
    """Partitions in which to read `size` bytes of files: one for each spark.sql.files.maxPartitionBytes, one a core at least.

    For readers whose rows only name what to read: left to adaptive execution, few rows become few tasks.
    """
    text = spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower().removesuffix("b")
    each = int(text[:-1]) << {"k": 10, "m": 20, "g": 30}[text[-1]] if text[-1] in "kmg" else int(text)
    return max(spark.sparkContext.defaultParallelism, -(-size // each))


def released(run: Callable) -> Callable:
    """run, which maps an iterator of batches, giving its memory back to the system when it ends: workers live on between tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def ascii_lower(text: Column) -> Column:
    """Only A-Z become lower case; lower() would change other scripts too."""
    return F.translate(text, UPPER, LOWER)


def words_column(text: Column) -> Column:
    """Array of the words of a text (null: empty array)."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of each text (null: none): offsets (n + 1), the distinct words, and for each word its place among them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    values = lists.flatten()
    empty = np.asarray(pc.equal(pc.binary_length(values), 0))
    if empty.any():  # an empty text splits into one empty word
        values = values.filter(pa.array(~empty))
        offsets = np.concatenate([[0], np.cumsum(~empty)])[offsets]
    coded = values.dictionary_encode()
    return offsets, coded.dictionary, np.asarray(coded.indices, dtype=np.int64)


#: A random odd number for each of the first bytes of a word.
_BYTE = np.random.default_rng(97).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word: the sum of its bytes, each times the number of its place, mixed with its length; longer words than the table one by one."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    held = words.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    begin, size = offsets[:-1] - offsets[0], np.diff(offsets)
    out, some = np.zeros(n, np.uint64), np.flatnonzero(size)
    with np.errstate(over="ignore"):
        if len(some):
            at = np.minimum(np.arange(len(data)) - np.repeat(begin, size), len(_BYTE) - 1)
            out[some] = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _BYTE[at], begin[some])
        out = mix(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(size > len(_BYTE)).tolist():
        out[i] = xxhash.xxh3_64_intdigest(words[i].as_py())
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that linear combinations become independent of their parts."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; a text of 1 to k - 1 words is one shingle; no word: empty."""
    offsets, distinct, codes = split_words(texts)
    w = hash_words(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = len(w)
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            rolled += w[j : n - k + 1 + j] * odd[j % 8] + np.uint64(j)
        rolled = mix(rolled)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                short = np.zeros(1, np.uint64)
                for j in range(b - a):
                    short += w[a + j] * odd[j % 8] + np.uint64(j)
                out.append(mix(short + np.uint64((b - a) * 0x9E3779B9)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20):
    """Consecutive parts of a batch with about `most` bytes of that column each (one row at least), so a task's memory is bounded."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)] if len(sizes) else []
    for a, b in zip(cuts, cuts[1:]):
        # A copy: string kernels of pyarrow misread some arrays that begin inside their buffers.
        yield batch if b - a == batch.num_rows else batch.take(pa.array(np.arange(a, b)))
