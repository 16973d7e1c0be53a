"""Token-id output: raw id shards in ascending document order and a minimal perfect hash index over the keys."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cipherlake.llm import mphf
from cipherlake.llm.common import fresh_path, read_parts, released, slices, staged
from cipherlake.llm.storage import AtomicFile, make_dir, open_file, read_file, write_file
from cipherlake.llm.tokenize import append_end, encoder

#: Shard header: magic, bytes of an id (2 where the vocabulary allows, else 4), end id.
HEADER = "<8sII"
MAGIC = b"IDSHARD1"
#: Bytes of a shard that one task reads in a row.
SPAN = 8 << 20


def _file(folder: str, kind: str, i: int) -> str:
    return f"{folder}/{kind}-{i:08d}"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encodes each text (null: empty) plus the end id into shards below folder; returns a staged table (doc_id, shard, offset, n_tokens).

    Rows are dealt by ranges of doc_id (nulls first) and sorted by doc_id, then by a hash of the
    text, so shards follow each other in ascending order. offset counts ids from the shard's
    start. Special-token strings in a text keep the ids that the tokenizer gives them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, shard, out, at = encoder(tokenizer), TaskContext.get().partitionId(), None, 0
        width = 2 if e.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        for batch in batches:
            for part in slices(batch, most=12 << 20):
                ids, n = append_end(*e.encode(part.column("text")), end_id)
                if out is None:
                    out = AtomicFile(_file(folder, "shard", shard))
                    out.write(struct.pack(HEADER, MAGIC, width, end_id))
                out.write(ids.astype("<u2" if width == 2 else "<u4").tobytes())
                ends = at + np.cumsum(n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(ends - n), pa.array(n)], names=["doc_id", "shard", "offset", "n_tokens"])
                at = int(ends[-1]) if len(ends) else at
        if out is not None:
            out.close()

    make_dir(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Ranges are cut inside equal ids too, so many rows without an id or with the same one are no hot partition.
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(rows.mapInArrow(released(run), "doc_id long, shard int, offset long, n_tokens long"), "positions")


def write_index(positions: DataFrame, folder: str) -> int:
    """Writes one index file for each bucket of about mphf.BUCKET keys; returns the number of buckets. Rows without a doc_id have no key."""
    positions = positions.where("doc_id IS NOT NULL")
    buckets = max(1, -(-positions.count() // mphf.BUCKET))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(mphf.bucket_of(keys, buckets)), pa.array(keys), *(batch.column(c) for c in ("shard", "offset", "n_tokens"))], names=["bucket", "key", "shard", "offset", "n_tokens"])

    def build(g: pa.Table) -> pa.Table:
        g = g.sort_by([("key", "ascending"), ("shard", "ascending"), ("offset", "ascending")])
        key = g.column("key").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        data = mphf.pack_index(key[first], np.concatenate([first, [len(key)]]), {"shard": g.column("shard").to_numpy().astype(np.int32), "offset": g.column("offset").to_numpy(), "n_tokens": g.column("n_tokens").to_numpy()})
        write_file(_file(folder, "index", g.column("bucket")[0].as_py()), data)
        return pa.table({"keys": pa.array([len(first)], pa.int64())})

    staged(positions.mapInArrow(placed, "bucket long, key long, shard int, offset long, n_tokens long").groupBy("bucket").applyInArrow(build, "keys long"), "index")
    return buckets


def lookup(keys: DataFrame, folder: str, buckets: int) -> DataFrame:
    """(doc_id, shard, offset, n_tokens) of each distinct doc_id of keys that the index holds, from the index files alone."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.asarray(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(mphf.bucket_of(k, buckets)), batch.column("doc_id")], names=["bucket", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for batch in batches:
            bucket = np.asarray(batch.column("bucket"))
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if bucket[a] != held:
                    held, index = bucket[a], mphf.Index(read_file(_file(folder, "index", int(bucket[a]))))
                ids = batch.column("doc_id").slice(a, b - a)
                at, found = index.find(np.asarray(ids))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(found[c]) for c in ("shard", "offset", "n_tokens"))], names=["doc_id", "shard", "offset", "n_tokens"])

    keys = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().mapInArrow(placed, "bucket long, doc_id long")
    parts = read_parts(keys.sparkSession, buckets * mphf.BUCKET * 32)  # about 32 bytes a key in an index file
    return keys.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, shard int, offset long, n_tokens long")


def read_ids(places: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Reads the ids of (doc_id, shard, offset, n_tokens) rows from the shards: adds ids_crc32, and ids if wanted.

    A task reads spans of SPAN ids of some shards, each in ascending offsets; the number of tasks
    follows from the bytes to read.
    """
    spark = places.sparkSession
    parts = read_parts(spark, 4 * (places.agg(F.sum("n_tokens")).first()[0] or 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, f, width = None, None, 2
        for batch in batches:
            shard, offset, n = (np.asarray(batch.column(c)) for c in ("shard", "offset", "n_tokens"))
            crc, ids = np.zeros(len(shard), np.int64), []
            for i in range(len(shard)):
                if shard[i] != held:
                    if f is not None:
                        f.close()
                    held, f = shard[i], open_file(_file(folder, "shard", int(shard[i])))
                    magic, width, _ = struct.unpack(HEADER, f.read(struct.calcsize(HEADER)))
                    if magic != MAGIC:
                        raise ValueError("not an id shard")
                f.seek(struct.calcsize(HEADER) + int(offset[i]) * width)
                data = f.read(int(n[i]) * width)
                if len(data) != n[i] * width:
                    raise ValueError("shard is shorter than its index says")
                found = np.frombuffer(data, "<u2" if width == 2 else "<u4").astype("<u4")
                crc[i] = zlib.crc32(found.tobytes())
                if with_ids:
                    ids.append(found.astype(np.int64))
            out = [*(batch.column(c) for c in ("doc_id", "shard", "offset", "n_tokens")), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else []), names=["doc_id", "shard", "offset", "n_tokens", "ids_crc32"] + (["ids"] if with_ids else []))

    schema = "doc_id long, shard int, offset long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    span = F.floor(F.col("offset") / SPAN)
    return places.select("doc_id", "shard", "offset", "n_tokens").repartition(parts, F.col("shard"), span).sortWithinPartitions("shard", "offset").mapInArrow(run, schema)


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes docs (doc_id, text, ...) to shards with an index, reads every document back by key: doc_id, start, n_tokens, ids_crc32.

    start is the number of ids of all documents before it in ascending doc_id order (nulls first,
    repeated ids in the order of a hash of their text). Null and empty texts hold the end id
    alone. Repeated rows and ids each keep their own row. A null doc_id is no key: such rows are
    read by their positions, all others through the index. An empty table gives no rows; further
    columns, of whatever name, are ignored; very long texts are written whole. Files are written beside their place and moved there, so a lost
    executor's tasks can run again.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    positions = write_shards(docs, folder, tokenizer, end_id)
    buckets = write_index(positions, folder)
    found = lookup(docs, folder, buckets).unionByName(positions.where("doc_id IS NULL").select("doc_id", "shard", "offset", "n_tokens"))
    read = read_ids(staged(found, "found"), folder)
    # One row a shard, summed before the only window without a key.
    totals = positions.groupBy("shard").agg(F.sum("n_tokens").alias("ids")).withColumn("base", F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)))
    return read.join(totals, "shard").select("doc_id", (F.coalesce("base", F.lit(0)) + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
