"""Benchmark decontamination: latent semantic retrieval of benchmark items, then common-subsequence and answer checks.

1. The words of each whole text become numbers once: the benchmark's words have a number each, all
   others share BUCKETS numbers by hash. The numbers are written and read by the later passes.
2. Document frequencies over all documents give the idf of each number.
3. A randomised SVD of the passages' TF-IDF matrix: tasks add up X'(X O) for a fixed random O, the
   driver turns the sum into RANK right singular vectors by Nystrom's formula. The rank doesn't
   depend on the benchmark; items are folded in and are no directions of their own.
4. Passages and item pieces are projected, strong directions scaled down to the middle one's
   variance, and compared by cosine. Beside them, passages whose words, order aside, make up `share` of a piece are
   candidates too (the lexical route): a latent space of fixed rank can't hold every rare item.
5. Candidates are checked by the longest common subsequence. For latent candidates, words near each
   other in the latent space count as equal in part, which is what finds rewordings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.common import ascii_lower, discard, hash_words, released, slices, split_words, staged, words_column

#: Words of a piece of an item at most.
PIECE = 32
#: Words of a lexical passage; they begin every half of it, so any 65 words in a row lie in one.
PASSAGE = 128
#: Words of a latent passage, and of the step between their beginnings.
LATENT, STEP = 48, 24
#: Rank of the latent space, random directions beyond it, hash buckets of words outside the benchmark, rows of the benchmark's words at most.
RANK, EXTRA, BUCKETS, OWN = 48, 16, 1 << 13, 1 << 14
#: Least cosine of a latent candidate, least exact share of a rewording, least cosine of words that stand for each other.
NEAR, EXACT, SYNONYM = 0.4, 0.35, 0.7
#: Benchmark items that are searched for at a time: what is broadcast is bounded by this, not by the benchmark.
ITEMS = 2000


@dataclass
class Searcher:
    """What a search task needs of a block of items."""

    idf: np.ndarray  # of each number
    pieces: np.ndarray  # rows of (piece, term, count), by piece and term
    first: np.ndarray  # first row of each piece, and their number
    weight: np.ndarray  # of each piece: idf of its words
    need: np.ndarray  # of each piece: what its heavy terms must weigh in a passage that holds `share` of it
    posted: np.ndarray  # first entry of each term in heavy, and their number
    heavy: np.ndarray  # pieces in which a term is among the heavy ones, by term
    heavy_weight: np.ndarray  # and its weight there
    piece_item: np.ndarray
    items: list[tuple[int, np.ndarray, np.ndarray]]  # item_id, terms in order, terms of the answer (empty: none given)
    row: np.ndarray  # row of each number in the latent tables
    project: np.ndarray  # of each row: its share of a passage's coordinates
    unit: np.ndarray  # of each row: its direction
    latent: np.ndarray  # of each piece: unit coordinates
    local: np.ndarray  # place of each number among the block's words, their number for other words
    held: np.ndarray  # of each piece: the places of its words by falling weight, filled up with the number of words
    held_weight: np.ndarray  # and their weights, filled up with 0


def _codes(texts: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of texts, number of each word): its place in the sorted hashes of the benchmark's words, or a bucket behind them."""
    offsets, distinct, codes = split_words(texts)
    if not len(codes):
        return offsets, np.zeros(0, np.int64)
    h = hash_words(distinct)
    at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
    own = words[at] == h if len(words) else np.zeros(len(h), bool)
    return offsets, np.where(own, at, len(words) + (h >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)[codes]


def _numbered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, numbers) of the rows of a batch of coded texts."""
    data = batch.column("codes").to_pylist()
    return np.concatenate([[0], np.cumsum([len(x) // 4 for x in data])]).astype(np.int64), np.frombuffer(b"".join(data), "<u4").astype(np.int64)


def coded(docs: DataFrame, words: np.ndarray) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((doc_id, codes): the word numbers of each whole text as unsigned 32-bit integers; (df): for each task its documents with each number, and their count).

    Both are parts of one table, the third element, which is written to the shared folder once, for all passes.
    """
    held, size = docs.sparkSession.sparkContext.broadcast(words), len(words) + BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        names = ["doc_id", "codes", "df"]
        for whole in batches:
            for batch in slices(whole):
                offsets, codes = _codes(batch.column("text"), held.value)
                per = max(1, (1 << 23) // size)
                for a in range(0, batch.num_rows, per):  # which numbers a text holds, a few texts at a time
                    b = min(batch.num_rows, a + per)
                    holds = np.zeros((b - a, size), bool)
                    holds[np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1])), codes[offsets[a] : offsets[b]]] = True
                    total[:size] += holds.sum(0)
                total[size] += batch.num_rows
                data = codes.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([data[4 * a : 4 * b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())], pa.binary()), pa.nulls(batch.num_rows, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    out = staged(docs.mapInArrow(released(run), "doc_id long, codes binary, df binary"), "codes")
    return out.where("codes IS NOT NULL").select("doc_id", "codes"), out.where("df IS NOT NULL").select("df"), out


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, index) of each element of ranges that begin at first and hold size elements."""
    of = np.repeat(np.arange(len(first)), size)
    return of, np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(of))


def _passages(offsets: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the passages: size words from every step-th word on, so that every word is in one."""
    n = np.diff(offsets)
    count = np.where(n > 0, np.maximum(1, -(-(n - (size - step)) // step)), 0)
    text, nth = _spread(np.zeros(len(n), np.int64), count)
    begin = offsets[:-1][text] + nth * step
    return text, begin, np.minimum(begin + size, offsets[1:][text])


def document_frequencies(counts: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """(number of documents, documents with each number), over all documents, from the tasks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for data in batch.column("df"):
                total += np.frombuffer(data.as_buffer(), "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    df = np.zeros(size + 1, np.int64)
    for r in counts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a number
        df[r.term] = r.n
    return int(df[size]), df[:size]


#: Rows of the latent table that travel together.
ROWS = 1024


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks in a stream that is sorted by block, one block held at a time."""
    held, total = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([total.astype("<f4").tobytes()])], names=["block", "data"])
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
            if block != held:
                if held is not None:
                    yield out()
                held, total = block, 0.0
            total = total + np.frombuffer(data.as_py(), "<f4").astype(np.float64)
    if held is not None:
        yield out()


def latent_vectors(numbers: DataFrame, row: np.ndarray, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors rows x rank, singular values) of the TF-IDF matrix of all passages of LATENT words, scaled to unit length.

    Each task sums X'(X O) over its passages, O being rows x (rank + EXTRA) normal numbers from a
    seed. Tasks are merged to a few for each core, or one for each 256 MB, so the partial sums, whose
    size is fixed, stay small against the input; they are added up in two levels.
    """
    spark = numbers.sparkSession
    size, wide = int(row.max()) + 1, rank + EXTRA
    held = spark.sparkContext.broadcast((row.astype(np.int32), idf.astype(np.float32)))

    def omega() -> np.ndarray:
        return np.random.default_rng(seed).standard_normal((size, wide)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (row, idf), o, total = held.value, omega(), np.zeros((size, wide), np.float32)
        some = False
        for whole in batches:
            for batch in slices(whole, "codes", 1 << 20):
                offsets, codes = _numbered(batch)
                _, begin, _ = _passages(offsets, LATENT, LATENT)
                passage = np.zeros(len(codes), np.int64)
                passage[begin] = 1
                key, n = np.unique((np.cumsum(passage) - 1) * size + row[codes], return_counts=True)
                if not len(key):
                    continue
                of, at = key // size, key % size
                value = (n * idf[at]).astype(np.float32)
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                value /= np.sqrt(np.maximum(np.add.reduceat(value * value, first), 1e-12))[of]
                # Rows of X, filled up to LATENT entries, for X O; then entries by column, for X'(X O).
                rows, values = np.zeros((len(first), LATENT), np.int32), np.zeros((len(first), LATENT), np.float32)
                nth = np.arange(len(of)) - first[of]
                rows[of, nth], values[of, nth] = at, value
                y = np.zeros((len(first), wide), np.float32)
                for k in range(LATENT):
                    y += values[:, k, None] * o[rows[:, k]]
                order = np.argsort(at, kind="stable")
                at, of, value = at[order], of[order], value[order]
                begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                end = np.append(begin[1:], len(at))
                many = end - begin
                for a, b in zip(begin[many > 16].tolist(), end[many > 16].tolist()):
                    total[at[a]] += value[a:b] @ y[of[a:b]]
                for low, high in ((0, 2), (2, 6), (6, 16)):  # short ones side by side, filled up with zeros
                    pick = np.flatnonzero((many > low) & (many <= high))
                    part = np.zeros((len(pick), wide), np.float32)
                    for k in range(high):
                        j = np.minimum(begin[pick] + k, len(at) - 1)
                        part += np.where(k < many[pick], value[j], 0)[:, None] * y[of[j]]
                    total[at[begin[pick]]] += part
                some = True
        if some:
            blocks = range(-(-size // ROWS))
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([total[b * ROWS : (b + 1) * ROWS].astype("<f4").tobytes() for b in blocks])], names=["block", "data"])

    size_mb = numbers.agg(F.sum(F.octet_length("codes"))).first()[0] or 0
    few = numbers.coalesce(max(3 * spark.sparkContext.defaultParallelism, -(-size_mb // (256 << 20))))
    parts = few.mapInArrow(released(run), "block int, data binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    once = parts.repartition("block", "salt").sortWithinPartitions("block", "salt").select("block", "data").mapInArrow(_summed, "block int, data binary")
    twice = once.repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "block int, data binary")
    b = np.zeros((size, wide))
    for r in twice.collect():  # size x wide numbers, which the constants bound
        b[r.block * ROWS : (r.block + 1) * ROWS] = np.frombuffer(r.data, "<f4").reshape(-1, wide)
    o = omega().astype(np.float64)
    shift = 1e-6 * max(1e-12, float(np.linalg.norm(b)))
    b = b + shift * o
    core = o.T @ b
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > 1e-9 * max(1e-12, values.max())
    u, s, _ = np.linalg.svd(b @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    s = np.sqrt(np.maximum(s * s - shift, 0.0))[:rank]
    return u[:, : len(s)], s


def _searcher(items: list[tuple[int, np.ndarray, np.ndarray]], idf: np.ndarray, row: np.ndarray, row_idf: np.ndarray, vectors: np.ndarray, spread: np.ndarray, share: float) -> Searcher:
    rows, weights, need, heavy, of = [], [], [], [], []
    for k, (_, terms, _) in enumerate(items):
        for piece in np.array_split(terms, -(-len(terms) // PIECE)):
            term, count = np.unique(piece, return_counts=True)
            w = count * idf[term]
            # Terms by falling weight until the rest weigh half of `share`: a passage with `share` of the piece has the other half in these.
            order = np.argsort(-w, kind="stable")
            rest = w.sum() - np.cumsum(w[order])
            most = 1 + int(np.argmax(rest <= share / 2 * w.sum()))
            heavy += [(int(term[j]), len(of), float(w[j])) for j in order[:most]]
            need.append(share * w.sum() - max(0.0, float(rest[most - 1])))
            rows.append(np.column_stack([np.full(len(term), len(of)), term, count]))
            weights.append(w.sum())
            of.append(k)
    heavy.sort()
    posted = np.searchsorted(np.array([h[0] for h in heavy]), np.arange(len(idf) + 1))
    pieces, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    good = spread > 1e-4 * max(spread.max(initial=0.0), 1e-12)
    # Directions stronger than the middle one (languages, common words) are brought down to its variance; weaker ones are not brought up.
    middle = float(np.median(spread[good])) if good.any() else 1.0
    project = (row_idf[:, None] * vectors[:, good] / np.maximum(spread[good], middle)).astype(np.float32)
    unit = vectors[:, good] * np.minimum(spread[good], middle) ** 2
    unit = (unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    latent = np.add.reduceat(pieces[:, 2:3] * project[row[pieces[:, 1]]], first[:-1], axis=0) if good.any() else np.zeros((len(of), 0))
    latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    own = np.unique(np.concatenate([x for _, terms, answer in items for x in (terms, answer)]))
    local = np.full(len(idf), len(own), np.int32)
    local[own] = np.arange(len(own))
    held = np.full((len(of), PIECE), len(own), np.int32)
    held_weight = np.zeros((len(of), PIECE), np.float32)
    for c, (a, b) in enumerate(zip(first, first[1:])):
        w = pieces[a:b, 2] * idf[pieces[a:b, 1]]
        order = np.argsort(-w, kind="stable")
        held[c, : b - a], held_weight[c, : b - a] = local[pieces[a:b, 1]][order], w[order]
    return Searcher(idf, pieces, first, np.array(weights), np.array(need), posted, np.array([h[1] for h in heavy]), np.array([h[2] for h in heavy]), np.array(of), items, row, project, unit, latent, local, held, held_weight)


def _counts(begin: np.ndarray, end: np.ndarray, at: np.ndarray, terms: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage * n_terms + term, count), ascending, of the words of passages that are at the places `at`."""
    lo, hi = np.searchsorted(at, begin), np.searchsorted(at, end)
    of, i = _spread(lo, hi - lo)
    return np.unique(of * n_terms + terms[at[i]], return_counts=True)


def _shared(s: Searcher, p: np.ndarray, c: np.ndarray, begin: np.ndarray, end: np.ndarray, inside: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight of the piece's words in the passage, order aside; TF-IDF cosine over the block's words) of pairs of passages and pieces."""
    if not len(p):
        return np.zeros(0), np.zeros(0)
    n_terms = len(s.idf)
    some, p_at = np.unique(p, return_inverse=True)
    key, n = _counts(begin[some], end[some], inside, codes, n_terms)
    if not len(key):
        return np.zeros(len(p)), np.zeros(len(p))
    norm2 = np.bincount(key // n_terms, n * s.idf[key % n_terms] ** 2, len(some))
    pair, row = _spread(s.first[c], np.diff(s.first)[c])
    wanted = p_at[pair] * n_terms + s.pieces[row, 1]
    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    held, mine, idf = np.where(key[at] == wanted, n[at], 0), s.pieces[row, 2], s.idf[s.pieces[row, 1]]
    overlap = np.bincount(pair, np.minimum(held, mine) * idf, len(p))
    return overlap, np.bincount(pair, np.sqrt(held * mine) * idf**2, len(p)) / np.sqrt(np.maximum(1e-12, np.bincount(pair, mine * idf**2, len(p)) * norm2[p_at]))


def lexical_candidates(s: Searcher, begin: np.ndarray, end: np.ndarray, inside: np.ndarray, codes: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, piece, cosine) of all passages whose words make up `share` of a piece, order aside."""
    n_terms, n_pieces = len(s.idf), len(s.weight)
    postings = np.diff(s.posted)
    key, _ = _counts(begin, end, inside[postings[codes[inside]] > 0], codes, n_terms)
    passage, term = key // n_terms, key % n_terms
    per = max(1, (1 << 21) // n_pieces)
    found = []
    for a in range(0, len(begin), per):
        lo, hi = np.searchsorted(passage, [a, a + per])
        of, i = _spread(s.posted[term[lo:hi]], postings[term[lo:hi]])
        n = min(per, len(begin) - a)
        got = np.bincount((passage[lo:hi][of] - a) * n_pieces + s.heavy[i], s.heavy_weight[i], n * n_pieces).reshape(n, n_pieces)
        p, c = np.nonzero(got >= s.need - 1e-6)
        found.append((p + a, c))
    p, c = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    overlap, cosine = _shared(s, p, c, begin, end, inside, codes)
    keep = overlap >= share * s.weight[c] - 1e-6
    return p[keep], c[keep], cosine[keep]


def latent_candidates(s: Searcher, offsets: np.ndarray, codes: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end, piece, cosine) of the passages of LATENT words that lie near a piece in the latent space.

    Those that hold less than EXACT of the piece's words, order aside, are left out at once: the
    common subsequence could not reach that share.
    """
    n_words = int(s.local.max()) + 1
    text, begin, end = _passages(offsets, STEP, STEP)  # blocks; a passage is the sum of some successive ones
    found, ahead = [], LATENT // STEP
    per = max(32, min((1 << 21) // max(len(s.latent), 1), (1 << 23) // n_words))
    first, rest = s.held[:, :8], s.held_weight[:, 8:].sum(1)
    least = EXACT * s.weight - 1e-4
    there = np.zeros((per + ahead, n_words), bool)  # words of each block; the last row stays empty
    for a in range(0, len(begin) if s.project.shape[1] else 0, per):
        b = min(len(begin), a + per + ahead - 1)
        words = codes[begin[a] : end[b - 1]]
        local = s.local[words]
        own = np.flatnonzero(local < n_words - 1)  # the others are words of no item
        of = np.repeat(np.arange(b - a), end[a:b] - begin[a:b])[own], local[own]
        there[of] = True
        z, at, size = np.zeros((b - a, s.project.shape[1]), np.float32), begin[a:b] - begin[a], end[a:b] - begin[a:b]
        for k in range(STEP):
            i = np.flatnonzero(size > k)
            z[i] += s.project[s.row[words[at[i] + k]]]
        n = min(per, b - a)
        whole, last, blocks = z[:n].copy(), end[a : a + n].copy(), [np.arange(n)]
        for k in range(1, ahead):
            i = np.flatnonzero(np.arange(n) + k < b - a)
            i = i[text[a + i + k] == text[a + i]]
            whole[i] += z[i + k]
            last[i] = end[a + i + k]
            blocks.append(np.full(n, per + ahead - 1))
            blocks[-1][i] = i + k

        def holds(q: np.ndarray, of: np.ndarray) -> np.ndarray:
            out = there[q[:, None], of]
            for rows in blocks[1:]:
                out |= there[rows[q][:, None], of]
            return out

        whole /= np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12)
        cosine = whole @ s.latent.T
        p, c = np.nonzero(cosine >= near)
        for x in range(0, len(p), 1 << 17):
            q, d = p[x : x + (1 << 17)], c[x : x + (1 << 17)]
            keep = (holds(q, first[d]) * s.held_weight[d, :8]).sum(1) + rest[d] >= least[d]
            q, d = q[keep], d[keep]
            keep = (holds(q, s.held[d]) * s.held_weight[d]).sum(1) >= least[d]
            q, d = q[keep], d[keep]
            found.append((text[a + q], begin[a + q], last[q], d, cosine[q, d]))
        there[of] = False
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4 + (np.zeros(0),)


def common_weight(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """Largest weight of a common subsequence of a and b; weight is that of each element of a."""
    return aligned_weight((b == x for x in a), weight, len(b))


def aligned_weight(rows: Iterable[np.ndarray], weight: np.ndarray, width: int) -> float:
    """Largest weight of a common subsequence where element i of one and j of the other agree by the j-th number of row i, from 0 to 1.

    Rows are taken one at a time, so an item and a region of any length need memory for one row only.
    """
    best = np.zeros(width + 1)
    for x, w in zip(rows, weight):
        step = best.copy()
        hit = np.flatnonzero(x)
        step[hit + 1] = np.maximum(step[hit + 1], best[hit] + w * x[hit])
        best = np.maximum.accumulate(step)
    return float(best[-1])


def _alike(s: Searcher, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """For each word of a, how far those of b stand for it: 1 if equal, their cosine in the latent space from SYNONYM on, else 0."""
    distinct, place = np.unique(b, return_inverse=True)
    of = s.unit[s.row[distinct]].T
    for word in a:
        cosine = s.unit[s.row[word]] @ of
        yield np.where(distinct == word, 1.0, np.where(cosine >= SYNONYM, cosine, 0.0))[place]


def _matches(s: Searcher, offsets: np.ndarray, codes: np.ndarray, share: float, sure: float, near: float) -> Iterator[tuple]:
    """(text, item, cosine, latent cosine, exact share, share with rewordings, first word, end word) of the items found in the texts."""
    inside = np.flatnonzero(s.local[codes] < s.local.max()) if len(codes) else np.zeros(0, np.int64)
    text, begin, end = _passages(offsets, PASSAGE, PASSAGE // 2)
    p, c, cosine = lexical_candidates(s, begin, end, inside, codes, share)
    seen = [(text[p], begin[p], end[p], c, cosine, np.full(len(p), -1.0))]
    text, begin, end, c, score = latent_candidates(s, offsets, codes, near)
    _, cosine = _shared(s, np.arange(len(c)), c, begin, end, inside, codes)
    seen.append((text, begin, end, c, cosine, score))
    regions: dict[tuple[int, int], list] = {}
    for t, b, e, c, cos, lat in sorted(zip(*(np.concatenate(x).tolist() for x in zip(*seen)))):
        k = int(s.piece_item[c])
        n = len(s.items[k][1])
        lo, hi = max(int(offsets[t]), b - n), min(int(offsets[t + 1]), e + n)
        spans = regions.setdefault((t, k), [])
        if spans and lo <= spans[-1][1]:
            last = spans[-1]
            last[1], last[2], last[3] = max(hi, last[1]), max(last[2], cos), max(last[3], lat)
        else:
            spans.append([lo, hi, cos, lat])
    for (t, k), spans in regions.items():
        _, words, answer = s.items[k]
        weight = s.idf[words]
        last = answer if len(answer) else words[-max(3, len(words) // 4) :]
        w = s.idf[last]
        for lo, hi, cos, lat in spans:
            there = codes[lo:hi]
            got = soft = common_weight(words, there, weight) / weight.sum()
            if got >= sure or got >= share and common_weight(last, there, w) >= 0.5 * w.sum():
                yield t, k, cos, lat if lat >= 0 else None, got, got, int(lo - offsets[t]), int(hi - offsets[t])
            elif lat >= near and got >= EXACT:  # the answer in its own words, the rest may be reworded
                soft = aligned_weight(_alike(s, words, there), weight, len(there)) / weight.sum()
                if soft >= share and common_weight(last, there, w) >= 0.5 * w.sum():
                    yield t, k, cos, lat, got, soft, int(lo - offsets[t]), int(hi - offsets[t])


def find_contamination(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, sure: float = 0.8, min_words: int = 5, near: float = NEAR) -> DataFrame:
    """Items of benchmark (item_id, text, optionally answer) in docs (doc_id, text, ...): doc_id, item_id, cosine, latent, lcs_share, soft_share, first_word, end_word.

    Items are cut into pieces of at most PIECE words. Candidates are the passages of LATENT words whose
    cosine with a piece in the latent space is at least `near`, and the passages of PASSAGE words that
    hold `share` of a piece's weight (idf over all documents), order aside: where an item lies within 65
    words, one of its pieces does, so no near-verbatim one is missed, however long the item or the corpus.

    Around a candidate the longest common subsequence of the item and the text must make up `share` of
    the item's weight; below `sure`, half the weight of the answer (without one: of the last quarter of
    the item) must be there too. A latent candidate with at least EXACT of the item's own words also
    passes if it holds half of the answer in its own words and reaches `share` when words that are
    neighbours in the latent space count by their cosine. A row for each document and item, with the best region; lcs_share
    counts the item's own words, soft_share rewordings too; cosine is that of passage and piece by
    TF-IDF over the block's words, latent that of the latent space, null where only the words led there.

    Items with fewer than min_words words, null or empty ones match nothing; null and empty texts
    hold nothing; rows with equal doc_id count as one document; a null doc_id is kept as null. Very
    long texts are searched whole. Ties between regions go to the first. Empty tables give no rows;
    further columns, of whatever name, are ignored. Items are searched for in blocks of ITEMS; for all
    blocks together the driver holds the hashes of the benchmark's distinct words and the texts are
    cut into words once.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, latent double, lcs_share double, soft_share double, first_word long, end_word long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    answer = words_column(ascii_lower(F.col("answer").cast("string"))) if "answer" in benchmark.columns else F.array().cast("array<string>")
    listed = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), words_column(ascii_lower(F.col("text").cast("string"))).alias("words"), answer.alias("answer")).where(F.size("words") >= min_words)
    listed = staged(listed, "items")
    hashed: set[int] = set()
    for r in listed.select(F.explode(F.concat("words", "answer")).alias("w")).distinct().toLocalIterator():
        hashed.add(int(hash_words(pa.array([r.w]))[0]))
    if not hashed:
        return spark.createDataFrame([], schema)
    words = np.sort(np.fromiter(hashed, np.uint64, len(hashed)))
    size = len(words) + BUCKETS
    numbers, counts, written = coded(rows, words)
    n, df = document_frequencies(counts, size)
    idf = np.log((n + 1) / (df + 1)) + 0.05
    own = min(len(words), OWN)
    row = np.concatenate([np.arange(len(words)) if own == len(words) else (words % np.uint64(OWN)).astype(np.int64), own + np.arange(BUCKETS)])
    row_idf = np.log((n + 1) / (np.minimum(n, np.bincount(row, df)) + 1)) + 0.05
    vectors, spread = latent_vectors(numbers, row, row_idf)

    def search(block: list[tuple[int, np.ndarray, np.ndarray]]) -> DataFrame:
        held = spark.sparkContext.broadcast(_searcher(block, idf, row, row_idf, vectors, spread, share))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = held.value
            for whole in batches:
                for batch in slices(whole, "codes", 1 << 20):
                    found = list(_matches(s, *_numbered(batch), share, sure, near))
                    ids = batch.column("doc_id").to_pylist()
                    cols = [[ids[f[0]] for f in found], [s.items[f[1]][0] for f in found], *([f[c] for f in found] for c in range(2, 8))]
                    kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "cosine", "latent", "lcs_share", "soft_share", "first_word", "end_word"])

        return numbers.mapInArrow(released(run), schema)

    def number(tokens: list[str]) -> np.ndarray:
        return np.searchsorted(words, hash_words(pa.array(tokens, pa.string()))).astype(np.int64)

    out, block = None, []
    for i, r in enumerate(listed.orderBy("item_id").toLocalIterator()):
        block.append((r.item_id, number(r.words), number(r.answer)))
        if len(block) == ITEMS:
            found = search(block)
            out, block = found if out is None else out.unionByName(found), []
    if block:
        found = search(block)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("soft_share", "lcs_share", "latent", "cosine", (-F.col("first_word")).alias("first"), "end_word")).alias("x")
    found = staged(out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.cosine", "x.latent", "x.lcs_share", "x.soft_share", (-F.col("x.first")).alias("first_word"), "x.end_word"), "contamination")
    discard(written, listed)  # the rows found are few; the numbers of all texts are not
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text holds a benchmark item, all columns kept.

    Texts are told apart by a 64-bit hash, so rows with a null doc_id and repeated doc_ids are judged by
    their own text; equal texts go together; null and empty texts stay; an empty table stays empty.
    """
    key = "_text_key"
    keyed = docs.withColumn(key, F.xxhash64("text"))
    gone = find_contamination(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(gone, key, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
