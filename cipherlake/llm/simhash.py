"""SimHash near-duplicates: fingerprints of word shingles, compared exactly in tiles by exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.common import discard, released, slices, staged
from cipherlake.llm.components import connected_components

#: Fingerprints of a tile that a task holds, and the parts of two tiles that are compared at a time.
TILE, PART = 1 << 18, 512
QUARTERS = (0xFFFF << np.arange(0, 64, 16, dtype=np.uint64)).astype(np.uint64)


def fingerprint(text: bytes, k: int = 4, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half of the XXH64 of the k-word shingles of an A-Z lower-cased text (fewer words: all as one; none: 0)."""
    words = text.split()
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    n = max(1, len(words) - k + 1)
    last = end[k - 1 :] if len(words) >= k else end[-1:]
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_of(joined[a:b], seed) for a, b in zip((end - size)[:n].tolist(), last.tolist())), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = pc.ascii_lower(pc.fill_null(batch.column("text").cast(pa.large_string()), "")).cast(pa.large_binary())
            fp = np.array([fingerprint(t.as_py(), k, seed) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), "doc_id long, fp long")


def _parts(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """An order of the fingerprints by the population counts of their quarters, parts of it, and the least and the largest counts of each part."""
    counts = np.bitwise_count(x[:, None] & QUARTERS).astype(np.int16)
    order = np.lexsort(counts.T[::-1])
    cuts = [(a, min(a + PART, len(x))) for a in range(0, len(x), PART)]
    low = np.array([counts[order[a:b]].min(0) for a, b in cuts])
    return order, cuts, low, np.array([counts[order[a:b]].max(0) for a, b in cuts])


def tile_forest(x: np.ndarray, y: np.ndarray | None, radius: int) -> np.ndarray:
    """For the fingerprints of tile x and then those of tile y (none: x against itself), the number of each one's tree: those linked by at most radius differing bits.

    Parts whose population counts lie further apart than the radius are skipped; all others are compared bit by bit.
    Links are not listed: a part of many near copies would have a square of them.
    """
    both = x if y is None else np.concatenate([x, y])
    label = np.arange(len(both))
    if not len(x) or y is not None and not len(y):  # a hash left a tile without fingerprints
        return label
    rows, row_cuts, row_low, row_high = _parts(x)
    cols, col_cuts, col_low, col_high = (rows, row_cuts, row_low, row_high) if y is None else _parts(y)
    shift = 0 if y is None else len(x)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, (a, b) in enumerate(row_cuts):
        gap = np.maximum(0, np.maximum(col_low - row_high[i], row_low[i] - col_high)).sum(1)
        gap[: i if y is None else 0] = radius + 1
        r = rows[a:b]
        for j in np.flatnonzero(gap <= radius):
            c = cols[slice(*col_cuts[j])] + shift
            near = np.bitwise_count(both[r, None] ^ both[c]) <= radius
            while near.any():
                # A link of each row and column that still joins two trees; then the links inside one tree are done.
                own, theirs = np.array([root(k) for k in r.tolist()]), np.array([root(k) for k in c.tolist()])
                near &= own[:, None] != theirs
                some = np.flatnonzero(near.any(1))
                for k, m in zip(some, near[some].argmax(1)):
                    p, q = root(own[k]), root(theirs[m])
                    label[max(p, q)] = min(p, q)
    return np.array([root(k) for k in range(len(both))], np.int64)


def _tiles(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """prints (sid, fp) dealt to pairs of tiles (x, y): the pairs whose population counts differ by no more than the radius.

    A tile holds fingerprints of one population count, so there are 65 kinds, each cut into tiles by a hash.
    """
    found = {r.ones: r.c for r in prints.groupBy(F.bit_count("fp").alias("ones")).agg(F.count("*").alias("c")).collect()}
    cut = [-(-found.get(ones, 0) // tile) for ones in range(65)]
    first = np.concatenate([[0], np.cumsum(cut)]).tolist()
    kinds = [(ones, first[ones], cut[ones], first[max(0, ones - radius)], first[min(65, ones + radius + 1)] - 1) for ones in range(65) if cut[ones]]
    table = prints.sparkSession.createDataFrame(kinds, "ones int, first long, cut long, lo long, hi long")
    rows = prints.withColumn("ones", F.bit_count("fp")).join(F.broadcast(table), "ones")
    rows = rows.withColumn("mine", F.col("first") + F.pmod(F.xxhash64("fp"), F.col("cut"))).withColumn("other", F.explode(F.sequence("lo", "hi")))
    return rows.select(F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).alias("second"), "fp", "sid")


def linked(prints: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): for each pair of tiles a forest over the sids whose fingerprints differ in at most radius bits; no link is lost, none is listed twice over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(key: tuple, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            fp, sid, second = np.asarray(t.column("fp")).view(np.uint64), np.asarray(t.column("sid")), np.asarray(t.column("second"))
            n = int((~second).sum())
            tree = tile_forest(fp, None, radius) if key[0] == key[1] else tile_forest(fp[:n], fp[n:], radius)
            some = np.flatnonzero(tree != np.arange(len(tree)))
            return pa.RecordBatch.from_arrays([pa.array(sid[some]), pa.array(sid[tree[some]])], names=["a", "b"])

        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = np.asarray(batch.column("x")), np.asarray(batch.column("y"))
            cuts = [0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), len(x)]
            for a, b in zip(cuts, cuts[1:]):
                now = (x[a], y[a])
                if now != last and held:
                    yield forest(last, held)
                    held = []
                last = now
                held.append(batch.slice(a, b - a))
        if held:
            yield forest(last, held)

    return _tiles(prints, radius, tile).repartition("x", "y").sortWithinPartitions("x", "y", "second").mapInArrow(released(run), "a long, b long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_duplicates(docs: DataFrame, radius: int = 4, k: int = 4, seed: int = 42, tile: int = TILE) -> DataFrame:
    """For each row of docs (doc_id, text, ...): doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints of A-Z lower-cased texts are those of `fingerprint`; documents are linked at radius or fewer differing bits,
    component_id is the smallest doc_id reachable, itself included. Equal fingerprints fall together before anything is compared.

    Null, empty and word-free texts have fingerprint zero and are linked like any other. Rows with a null doc_id get component_id
    null and link nothing. Repeated rows get the same result each; rows that share a doc_id but not their text are each in the
    component of their own fingerprint. Texts of any length are read whole. An empty table gives no rows; further columns are
    ignored. `tile` bounds what a task holds and changes no result: N fingerprints are copied about N / (2 * tile) + 2 * radius
    times.
    """
    sig = staged(fingerprints(docs, k, seed), "fingerprints")
    prints = staged(sig.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("sid")), "prints")
    # Two fingerprints can only share a smallest doc_id where ids repeat; then they are one node.
    links = staged(linked(prints, radius, tile), "links")
    labels = connected_components(links)
    of = prints.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("fp", F.coalesce("component", "sid").alias("component_id"))
    out = sig.join(of, "fp", "left").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    discard(links)
    return out
