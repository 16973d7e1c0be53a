"""Token counts by separator scan of flat token files that have no index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cipherlake.llm.common import fresh_path, read_parts, released, slices, staged
from cipherlake.llm.storage import AtomicFile, make_dir, open_file
from cipherlake.llm.tokenize import append_end, encoder

#: Bytes of a block that one task scans at a time.
BLOCK = 16 << 20


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes ids of the texts and the end id after each, as bare unsigned 16- or 32-bit little-endian numbers, one file a task; returns (file, row, doc_id, width).

    Strings of special tokens in a text are encoded as ordinary text, so the end id separates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, out, row = encoder(tokenizer, True), None, 0
        width = 2 if max(e.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        name = f"flat-{TaskContext.get().partitionId():08d}"
        for batch in batches:
            for part in slices(batch, most=12 << 20):
                ids, n = e.encode(part.column("text"))
                if (ids == end_id).any():
                    raise ValueError("the end id occurs in a text")
                out = out or AtomicFile(f"{folder}/{name}")
                out.write(append_end(ids, n, end_id)[0].astype("<u2" if width == 2 else "<u4").tobytes())
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * k, pa.string()), pa.array(np.arange(row, row + k)), part.column("doc_id"), pa.array(np.full(k, width, np.int32))], names=["file", "row", "doc_id", "width"])
                row += k
        if out is not None:
            out.close()

    make_dir(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(rows.mapInArrow(released(run), "file string, row long, doc_id long, width int"), "rows")


def scan_flat(files: DataFrame, folder: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """(file, row, n_tokens): ids between separators of flat files (file, width), documents numbered by their order.

    Blocks are scanned on their own for separators. A prefix scan over a file's blocks then numbers
    the documents (running sum of separators) and stitches those that cross blocks (running
    maximum of the last separator's position). Ids after the last separator are no document.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [open_file(f"{folder}/{f}").size() for f in batch.column("file").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["file", "width", "bytes"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, width, nth in zip(*(batch.column(c).to_pylist() for c in ("file", "width", "block"))):
                f = open_file(f"{folder}/{name}")
                f.seek(nth * block)
                at = np.flatnonzero(np.frombuffer(f.read(block), "<u2" if width == 2 else "<u4") == end_id) + nth * (block // width)
                f.close()
                first, last = (int(at[0]), int(at[-1])) if len(at) else (None, None)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([nth], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([np.diff(at) - 1], pa.list_(pa.int64()))], names=["file", "block", "n", "first", "last", "inner"])

    listed = staged(files.select("file", "width").distinct().mapInArrow(sizes, "file string, width int, bytes long").where("bytes > 0"), "files")
    parts = read_parts(files.sparkSession, listed.agg(F.sum("bytes")).first()[0] or 0)
    blocks = listed.select("file", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block))).alias("block"))
    found = blocks.repartition(parts, "file", "block").mapInArrow(scan, "file string, block long, n long, first long, last long, inner array<long>")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    stitched = found.select("file", "n", "inner", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("open")).where("n > 0")
    lengths = F.concat(F.array(F.col("first") - F.col("open") - 1), F.col("inner"))
    return stitched.select("file", "base", F.posexplode(lengths).alias("at", "n_tokens")).select("file", (F.col("base") + F.col("at")).alias("row"), "n_tokens")


def count_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, block: int = BLOCK) -> DataFrame:
    """Writes docs (doc_id, text, ...) to flat files and counts each document's ids by scanning them: doc_id, n_tokens (without the end id).

    Null and empty texts have 0 ids. Repeated rows get a row each; a null doc_id is kept; an empty
    table gives no rows; further columns, of whatever name, are ignored; texts of any length are
    stitched from their blocks.
    """
    folder = folder or fresh_path(docs.sparkSession, "flat")
    rows = write_flat(docs, folder, tokenizer, end_id)
    # Both sides grow with the documents, and the size of exploded lengths is underrated: never a broadcast.
    return rows.select("file", "row", "doc_id").join(scan_flat(rows, folder, end_id, block).hint("merge"), ["file", "row"]).select("doc_id", "n_tokens")
