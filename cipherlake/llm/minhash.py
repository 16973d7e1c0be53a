"""MinHash near-duplicates by tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.common import discard, mix, released, shingle_sets, slices, staged
from cipherlake.llm.components import connected_components

#: Rows of a bucket that are compared in one task at a time.
BLOCK = 1024


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(seed)
    return g.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), g.integers(0, 2**63, n, dtype=np.uint64)


def signatures(docs: DataFrame, rows: int, bands: int, k: int = 5, seed: int = 11) -> DataFrame:
    """doc_id, n (set size), set_hi, set_lo (128-bit hash of the set), left, right (half-band keys), sketch (a byte of each minhash).

    There are two collections of `bands` half bands with `rows` minhashes each. A table key is a
    pair of half bands, one of each collection: bands * bands tables of 2 * rows minhashes each
    from only 2 * bands * rows minhashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(2 * bands * rows, seed)
        for batch in (part for whole in batches for part in slices(whole)):
            sets = shingle_sets(batch.column("text"), k)
            n = np.array([len(s) for s in sets], np.int64)
            low = np.zeros((len(a), len(sets)), np.uint32)
            if n.any():
                flat = np.concatenate(sets)
                starts = np.concatenate([[0], np.cumsum(n)])[:-1][n > 0]
                with np.errstate(over="ignore"):
                    for i in range(len(a)):
                        h = (flat ^ b[i]) * a[i]
                        low[i, n > 0] = np.minimum.reduceat((h >> np.uint64(32)).astype(np.uint32), starts)
            with np.errstate(over="ignore"):
                half = np.zeros((2 * bands, len(sets)), np.uint64)
                for i in range(2 * bands * rows):
                    half[i // rows] = mix(half[i // rows] + low[i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            half = half.astype(np.int64)
            of = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            lists = lambda m: pa.ListArray.from_arrays(np.arange(0, bands * (len(sets) + 1), bands, dtype=np.int32), pa.array(np.ascontiguousarray(m.T).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(np.array([x >> 64 for x in of], np.uint64).astype(np.int64)), pa.array(np.array([x & (2**64 - 1) for x in of], np.uint64).astype(np.int64)), lists(half[:bands]), lists(half[bands:]), pa.array([x.tobytes() for x in np.ascontiguousarray(low.T.astype(np.uint8))], pa.binary())],
                names=["doc_id", "n", "set_hi", "set_lo", "left", "right", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), "doc_id long, n long, set_hi long, set_lo long, left array<long>, right array<long>, sketch binary")


def _least_matches(hashes: int, percent: int) -> int:
    """Matching minhashes below which a pair of that similarity is out by more than four standard deviations."""
    p = percent / 100
    return int(np.floor(hashes * p - 4 * np.sqrt(hashes * p * (1 - p))))


def _screened(pairs: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """Drops pairs whose sizes or sketches can't belong to a link."""

    @F.pandas_udf("boolean")
    def likely(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        m = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1)
        return pd.Series((m(x) == m(y)).sum(1) >= least)

    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).where(likely("sa", "sb")).select("a", "b")


def _confirmed(pairs: DataFrame, docs: DataFrame, sets: DataFrame, percent: int, k: int, salts: int = 32) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets.

    Texts are sent once for each pair they are b of, and once for each (a, salt) they are a of, so
    a representative with very many partners is neither a hot key nor copied for each of them.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    of = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(sets.select(F.col("sid").alias("id"), "set_hi", "set_lo"), "id")
    heads = pairs.select("a", "salt").distinct().join(of.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text", "set_hi", "set_lo")
    rest = pairs.join(of.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "text", "set_hi", "set_lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            found_a, found_b = [], []
            a, salt, b = (batch.column(c).to_pylist() for c in ("a", "salt", "b"))
            hi, lo = batch.column("set_hi").to_pylist(), batch.column("set_lo").to_pylist()
            for i, s in enumerate(shingle_sets(batch.column("text"), k)):
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                if h >> 64 != hi[i] % 2**64 or h % 2**64 != lo[i] % 2**64:
                    continue  # another row with the same doc_id
                if b[i] is None:
                    head, own = (a[i], salt[i]), s
                elif head == (a[i], salt[i]):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        found_a.append(a[i])
                        found_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return heads.unionByName(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(released(run), "a long, b long").distinct()


def fine_sketches(docs: DataFrame, sids: DataFrame, hashes: int, k: int, seed: int) -> DataFrame:
    """(sid, set_hi, set_lo, fine): a byte of each of many more minhashes, for the few sets of sids (sid, set_hi, set_lo) only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(hashes, seed + 1)
        for whole in batches:
            for batch in slices(whole):
                out, keep = [], []
                hi, lo = batch.column("set_hi").to_pylist(), batch.column("set_lo").to_pylist()
                for i, s in enumerate(shingle_sets(batch.column("text"), k)):
                    h = xxhash.xxh3_128_intdigest(s.tobytes())
                    if h >> 64 != hi[i] % 2**64 or h % 2**64 != lo[i] % 2**64:
                        continue  # another row with the same doc_id
                    low = np.full(hashes, np.iinfo(np.uint32).max, np.uint32)
                    with np.errstate(over="ignore"):
                        for at in range(0, len(s), 2048):
                            low = np.minimum(low, ((((s[at : at + 2048, None] ^ b) * a)) >> np.uint64(32)).astype(np.uint32).min(0))
                    keep.append(i)
                    out.append(low.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("sid").take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], names=["sid", "fine"])

    of = docs.select(F.col("doc_id").cast("long").alias("sid"), F.col("text").cast("string").alias("text")).join(sids, "sid").select("sid", "set_hi", "set_lo", "text")
    return of.mapInArrow(run, "sid long, fine binary").dropDuplicates(["sid"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in a sorted stream; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(c)) for c in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(c[a] for c in cols)
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _crossing(members: DataFrame, labels: DataFrame, sets: DataFrame, docs: DataFrame, percent: int, least: int, k: int, seed: int, fine: int = 512) -> DataFrame:
    """Likely pairs inside buckets whose members lie in different components, compared in blocks of BLOCK by BLOCK rows.

    Rows of a bucket's largest component meet the other rows only, never each other, so a bucket of
    N rows with R outside that component makes N * R / BLOCK copies at most. A pair is looked at in the first of its common buckets only, and put out if both the table
    minhashes and `fine` further ones leave the link possible (four standard deviations).
    """
    now = members.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    each = now.groupBy("key", "component").agg(F.count("*").alias("c"))
    open_ = each.groupBy("key").agg(F.count("*").alias("components"), F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("top")).where("components > 1").select("key", "size", F.col("top.c").alias("most"), F.col("top.component").alias("largest"))
    rows = staged(now.join(open_, "key"), "open")
    of = sets.join(rows.select("sid").distinct(), "sid")
    extra = staged(of.join(fine_sketches(docs, of.select("sid", "set_hi", "set_lo"), fine, k, seed), "sid").select("sid", "n", "sketch", "left", "right", "fine"), "fine")
    rows = rows.join(extra, "sid")
    # Blocks of the rows outside the largest component come first, then those of its own. A row of block i goes to the block
    # pairs (min(i, j), max(i, j)) for every j, one of the largest component for j outside it only.
    rows = rows.withColumn("outside", F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int")).withColumn("blocks", F.col("outside") + F.ceil(F.col("most") / BLOCK).cast("int"))
    inside = F.col("component") == F.col("largest")
    rows = rows.withColumn("mine", F.when(inside, F.col("outside") + F.pmod(F.xxhash64("sid"), F.col("blocks") - F.col("outside"))).otherwise(F.pmod(F.xxhash64("sid"), F.col("outside"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("outside")).otherwise(F.col("blocks")) - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "sid", "component", "n", "i", "j", "sketch", "left", "right", "fine")
    least_fine = _least_matches(fine, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["key", "p", "q"]):
            comp, n, sid, mine = (g.column(c).to_numpy() for c in ("component", "n", "sid", "mine"))
            p, q, i0, j0 = (g.column(c)[0].as_py() for c in ("p", "q", "i", "j"))
            m, more = (np.frombuffer(b"".join(g.column(c).to_pylist()), np.uint8).reshape(len(sid), -1) for c in ("sketch", "fine"))
            halves = [np.array(g.column(c).combine_chunks().flatten()).reshape(len(sid), -1)[:, :x] for c, x in (("left", i0), ("right", j0))]
            left, right = np.flatnonzero(mine == p), np.flatnonzero(mine == q)
            out = []
            for i in left:
                js = right[(comp[right] != comp[i]) & ((sid[right] > sid[i]) | (p != q))]
                js = js[np.minimum(n[js], n[i]) * 100 >= np.maximum(n[js], n[i]) * percent]
                js = js[(m[js] == m[i]).sum(1) >= least]
                js = js[(more[js] == more[i]).sum(1) >= least_fine]
                for h in halves:
                    js = js[~(h[js] == h[i]).any(1)]
                if len(js):
                    out.append(np.stack([np.minimum(sid[i], sid[js]), np.maximum(sid[i], sid[js])], 1))
            if out:
                out = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(released(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, rows: int = 3, bands: int = 9, seed: int = 11) -> DataFrame:
    """The rows of `labelled`: doc_id, n_shingles, component_id, kept."""
    return labelled(docs, percent, k, rows, bands, seed)[0]


def labelled(docs: DataFrame, percent: int = 80, k: int = 5, rows: int = 3, bands: int = 9, seed: int = 11) -> tuple[DataFrame, list[DataFrame]]:
    """For each row of docs (doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of distinct k-word
    shingles; component_id is the smallest doc_id reachable by links, kept marks that document.

    1. Equal sets fall together by a 128-bit hash, aggregated before the shuffle.
    2. Each distinct set gets bands * bands tensored table keys; each bucket links its members with
       its smallest and its largest member, a number of candidates linear in the members.
    3. Candidates are confirmed on full shingle sets read again from the texts; components follow.
    4. In buckets that still hold several components, members of different components are compared
       by longer sketches in blocks, likely pairs are confirmed, and the components are joined.
       No cap: every bucket is worked off.

    Null, empty and word-free texts have no shingles and are linked with nothing. Rows with a null
    doc_id get component_id null and kept true. Repeated rows get the same result each; where two
    rows share a doc_id, kept holds for both if either text is in the component of that id.
    An empty table gives no rows; further columns are ignored. Expected miss of a single pair at
    the threshold s: about 2 * (1 - s**rows)**bands. The second value lists the staged tables from which the rows are read.
    """
    sig = staged(signatures(docs, rows, bands, k, seed), "sig")
    sets = sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_hi", "set_lo").agg(F.min(F.struct("doc_id", "n", "left", "right", "sketch")).alias("s"))
    sets = staged(sets.select("set_hi", "set_lo", F.col("s.doc_id").alias("sid"), "s.n", "s.left", "s.right", "s.sketch"), "sets")
    keys = sets.select("sid", "right", F.posexplode("left").alias("i", "x")).select("sid", "i", "x", F.posexplode("right").alias("j", "y")).select(F.xxhash64("i", "j", "x", "y").alias("key"), "i", "j", "sid")
    buckets = keys.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi")
    members = staged(keys.join(buckets, "key"), "members")
    stars = members.select(F.col("lo").alias("a"), F.col("sid").alias("b")).unionByName(members.select(F.col("sid").alias("a"), F.col("hi").alias("b"))).where("a < b").distinct()
    least = _least_matches(2 * bands * rows, percent)
    links = staged(_confirmed(staged(_screened(stars, sets, percent, least), "pairs"), docs, sets, percent, k), "links")
    labels = staged(connected_components(links), "labels")
    more = staged(_confirmed(staged(_crossing(members.select("key", "i", "j", "sid"), labels, sets, docs, percent, least, k, seed), "pairs"), docs, sets, percent, k), "links")
    if not more.isEmpty():
        labels = staged(connected_components(labels.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more)), "labels")
    discard(members, links, more)
    of = sets.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("set_hi", "set_lo", F.coalesce("component", "sid").alias("component_id"))
    # Several sets can share a doc_id only if ids repeat; sids are minima of disjoint sets otherwise.
    out = sig.select("doc_id", F.col("n").alias("n_shingles"), "set_hi", "set_lo").join(of.withColumnRenamed("component_id", "found"), ["set_hi", "set_lo"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id"))))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), [sig, sets, labels]


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that near_duplicates does not keep; all columns stay, rows with a null doc_id too."""
    found, used = labelled(docs, **options)
    gone = staged(found.where("NOT kept").select("doc_id").distinct(), "gone")
    discard(*used)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
