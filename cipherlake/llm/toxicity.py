"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystrom landmarks.

The kernel compares short strings (words, words with their punctuation taken out, spelled-out
runs of single letters, windows of very long strings). Its features are subsequences of three
letters inside a span of SPAN letters, weighted DECAY for each letter skipped, word ends being
letters too; it is normalised. So a letter put into an insult, or signs between its letters, leave
most of its features in place. The machine is trained on Nystrom coordinates with respect to
landmark strings; since the kernel is an inner product of explicit features, the trained machine
folds into one table of weights for letter triples, and scoring a string costs a few look-ups
a letter whatever the number of landmarks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.common import mix, released, slices, split_words

SPAN, DECAY = 6, 0.6
#: Distances between the letters of a triple, and their weights.
PATTERNS = [(a, b, DECAY ** (a + b - 2)) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
#: Letters a to z are numbers 1 to 26, other letters 27 to 59 by their code point; then come start and end of a string.
START, END, TRIPLES = 62, 63, 1 << 18
#: Strings longer than this are scored in windows that overlap by half.
WINDOW = 24
_PIECES = re.compile(r"[^\W\d_]+")


def _numbers(letters: str) -> np.ndarray:
    code = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((code >= 97) & (code <= 122), code - 96, 27 + code % 33)


def units_of(token: str) -> list[str]:
    """Strings to compare in a token without white space: its letters, its longer pieces, windows of what is long."""
    pieces = _PIECES.findall(token)
    if not pieces:
        return []
    out = ["".join(pieces)]
    if len(pieces) > 1:
        out += [p for p in pieces if len(p) > 2]
    short = [u for u in out if len(u) <= WINDOW]
    for u in out:
        if len(u) > WINDOW:
            short += [u[i : i + WINDOW] for i in range(0, len(u) - WINDOW // 2, WINDOW // 2)]
    return short


def _letters(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the letters of all units with start and end marks, and the place where each unit begins."""
    size = np.fromiter(map(len, units), np.int64, len(units)) + 2
    flat = _numbers("".join(units))
    ends = np.cumsum(size)
    out = np.empty(int(size.sum()), np.int64)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = inner[ends - size] = False
    out[inner], out[ends - size], out[ends - 1] = flat, START, END
    return out, ends - size


def features(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, triple, weight) of the normalised feature vectors of the units."""
    letters, begins = _letters(units)
    of = np.repeat(np.arange(len(units)), np.diff(np.append(begins, len(letters))))
    keys, weights = [], []
    for a, b, w in PATTERNS:
        n = len(letters) - a - b
        if n <= 0:
            continue
        same = np.flatnonzero(of[:n] == of[a + b :])
        keys.append(of[same] * TRIPLES + (letters[same] * 64 + letters[same + a]) * 64 + letters[same + a + b])
        weights.append(np.full(len(same), w))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    keys, weights = keys[first], np.add.reduceat(weights, first) if len(first) else weights
    unit = keys // TRIPLES
    norm = np.sqrt(np.bincount(unit, weights * weights, len(units)))
    return unit, keys % TRIPLES, weights / norm[unit]


@dataclass
class Machine:
    """The folded machine: decision(unit) = table . features + bias; probability of a text = logistic(slopes . text_evidence)."""

    table: np.ndarray
    bias: float
    slopes: np.ndarray
    landmarks: list[str]

    def decide(self, units: list[str]) -> np.ndarray:
        out = np.empty(len(units))
        for a in range(0, len(units), 5000):
            part = units[a : a + 5000]
            unit, triple, weight = features(part)
            out[a : a + len(part)] = np.bincount(unit, self.table[triple] * weight, len(part)) + self.bias
        return out

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.slopes, -50, 50)))


#: Letter groups are told apart by so many bits of a hash.
GROUP_BITS = 22


def _groups(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(unit, group): hashed groups of four to six successive letters of each unit, ends included, and the whole unit."""
    if not units:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, begins = _letters(units)
    size = np.diff(np.append(begins, len(x)))
    of = np.repeat(np.arange(len(units)), size)
    who, code = [], []
    for k in (4, 5, 6):
        n = len(x) - k + 1
        if n <= 0:
            continue
        c = np.full(n, k, np.int64)
        for j in range(k):
            c = c * 65 + x[j : n + j]
        same = np.flatnonzero(of[:n] == of[k - 1 :])
        who.append(of[same])
        code.append(c[same])
    whole = np.add.reduceat((x + 7) * (np.arange(len(x)) - np.repeat(begins, size) + 1) ** 3, begins) + size * 7919
    who.append(np.arange(len(units)))
    code.append(whole + (1 << 50))
    code = np.concatenate(code).astype(np.uint64)
    return np.concatenate(who), (mix(code) >> np.uint64(64 - GROUP_BITS)).astype(np.int64)


@dataclass
class Bags:
    """Labelled texts as bags: unit code[i] of text t for offsets[t] <= i < offsets[t + 1]; tokens[t] is its number of tokens."""

    units: pa.Array
    code: np.ndarray
    offsets: np.ndarray
    tokens: np.ndarray
    toxic: np.ndarray

    @classmethod
    def of(cls, docs: list[list[str]], toxic: np.ndarray) -> "Bags":
        flat = pa.array([u for d in docs for u in d], pa.string()).dictionary_encode()
        size = np.array([len(d) for d in docs], np.int64)
        return cls(flat.dictionary, np.asarray(flat.indices, dtype=np.int32), np.concatenate([[0], np.cumsum(size)]), size, np.asarray(toxic, bool))

    def strings(self, code: np.ndarray) -> list[str]:
        return self.units.take(pa.array(code, pa.int64())).to_pylist()


def _distinct_texts(bags: Bags) -> np.ndarray:
    """One text of each group of near copies: equal two-fold minhashes of the units."""
    seen: dict[tuple, int] = {}
    h = mix(np.arange(len(bags.units), dtype=np.uint64) + np.uint64(1))
    for t in range(len(bags.toxic)):
        own = h[bags.code[bags.offsets[t] : bags.offsets[t + 1]]]
        seen.setdefault((int(own.min()), int((~own).min())) if len(own) else (), t)
    return np.sort(np.fromiter(seen.values(), np.int64, len(seen)))


def _witness_groups(bags: Bags) -> np.ndarray:
    """Letter groups that mark toxic texts: in far more of them than of the others, by more than chance explains.

    A group counts if the lower bound of its rate in toxic texts is several times the upper bound of
    its rate in the others, so stems that occur by chance in some clean texts count too. Near copies
    count once; one text's groups are held at a time.
    """
    found, absent = np.zeros(1 << GROUP_BITS, np.int32), np.zeros(1 << GROUP_BITS, np.int32)
    texts = _distinct_texts(bags)
    for t in texts:
        d = np.unique(_groups(bags.strings(bags.code[bags.offsets[t] : bags.offsets[t + 1]]))[1])
        (found if bags.toxic[t] else absent)[d] += 1
    n1 = int(bags.toxic[texts].sum())
    n0 = len(texts) - n1
    if not n1 or not n0:
        return np.zeros(0, np.int64)
    share, least = n1 / len(texts), 3
    while least < 20 and int((found + absent >= least).sum()) * share ** (0.8 * least) > 1.0:
        least += 1  # fewer texts than this may share a group by chance
    some = np.flatnonzero(found >= least)
    a, b = found[some].astype(float), absent[some].astype(float)
    clear = a - 15 * share / (1 - share) * b - 2 * (b > 0) >= least
    low, high = (a - 3 * np.sqrt(a)) / n1, (b + 1.0 + np.sqrt(b)) / n0
    return some[clear | ((a >= 8) & (low >= 2.0 * high))]


def _holding(units: list[str], wanted: np.ndarray) -> list[str]:
    """The units with one of the wanted groups."""
    out = []
    table = np.zeros(1 << GROUP_BITS, bool)
    table[wanted] = True
    for a in range(0, len(units), 20_000):
        part = units[a : a + 20_000]
        who, code = _groups(part)
        out += [part[i] for i in np.unique(who[table[code]])]
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine in the primal by Newton steps; returns (w, bias)."""
    n = x.shape[1]
    ridge = np.eye(n + 1)
    ridge[-1, -1] = 1e-3
    w = np.zeros(n + 1)
    for _ in range(steps):
        left, right = ridge.copy(), np.zeros(n + 1)
        for a in range(0, len(x), 2000):
            part = np.hstack([x[a : a + 2000], np.ones((len(x[a : a + 2000]), 1))])
            on = 1 - y[a : a + 2000] * (part @ w) > 0
            part, cost = part[on], weight[a : a + 2000][on] * c
            left += part.T @ (part * cost[:, None])
            right += part.T @ (cost * y[a : a + 2000][on])
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


class Landmarks:
    """Feature vectors of the landmark strings on the triples that occur in them."""

    def __init__(self, units: list[str]):
        unit, triple, weight = features(units)
        self.triples = np.unique(triple)
        self.column = np.full(TRIPLES, len(self.triples))  # the last row of the table is zero
        self.column[self.triples] = np.arange(len(self.triples))
        self.table = np.zeros((len(self.triples) + 1, len(units)))
        self.table[self.column[triple], unit] = weight

    def against(self, units: list[str]) -> np.ndarray:
        """Kernel of each unit with each landmark."""
        out = np.zeros((len(units), self.table.shape[1]))
        for a in range(0, len(units), 200):
            unit, triple, weight = features(units[a : a + 200])
            some = self.column[triple] < len(self.triples)
            unit, rows = unit[some], self.table[self.column[triple[some]]] * weight[some, None]
            if len(unit):
                first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
                out[a + unit[first]] = np.add.reduceat(rows, first, axis=0)
        return out

    def weights(self, beta: np.ndarray) -> np.ndarray:
        """Table of triple weights of the function sum of beta * kernel(., landmark)."""
        out = np.zeros(TRIPLES)
        out[self.triples] = self.table[:-1] @ beta
        return out


def _inserted(units: list[str], g: np.random.Generator) -> list[str]:
    """A copy of each unit with a letter put in at a random place."""
    return [u[: (i := int(g.integers(1, len(u))))] + chr(97 + int(g.integers(26))) + u[i:] for u in units if len(u) > 3]


#: Strings that the machine is fitted on, at most: of toxic texts, of others (the commonest; drawn; like the toxic ones; nearest the margin), and those searched for the last.
POSITIVES, COMMON, DRAWN, ALIKE, NEAREST, SEARCHED = 3000, 3000, 6000, 4000, 4000, 300_000


def fit(bags: Bags, landmarks: int = 240, seed: int = 5) -> Machine:
    """Trains on labelled texts given as bags of distinct units.

    A toxic text is a bag with at least one toxic unit: letter groups that explain the bags point
    out those units; units of the other texts are negative examples. After a first machine, the
    negatives nearest to the margin are added, and of each toxic text without a pointed-out unit the
    nearest one if it is near, and it is trained again. A text's probability is a logistic function
    of what text_evidence() says of its units.

    The bags are a bounded sample of labelled rows; of their strings at most POSITIVES + COMMON +
    DRAWN + ALIKE + NEAREST enter the machine, drawn by seed where there are more.
    """
    g = np.random.default_rng(seed)
    toxic = bags.toxic
    prior = float(toxic.mean()) if len(toxic) else 0.0
    none = Machine(np.zeros(TRIPLES), 0.0, np.array([0.0, 0.0, 0.0, float(np.log((prior + 1e-3) / (1 - prior + 1e-3))) if prior < 0.5 else 0.1]), [])
    if not toxic.any() or toxic.all():
        return none
    wanted = _witness_groups(bags)
    of = np.repeat(toxic, np.diff(bags.offsets))
    toll, often = (np.bincount(bags.code[x], minlength=len(bags.units)) for x in (of, ~of))
    rate = (toll / toxic.sum()) / ((often + 0.5) / (~toxic).sum())
    held = np.flatnonzero((toll > 0) & (rate > 1.5))
    at = {u: int(c) for u, c in zip(bags.strings(held), held)}
    hits = _holding(sorted(at), wanted)
    if not hits:
        return none
    pick = lambda units, n: [units[i] for i in sorted(g.permutation(len(units))[:n])]
    hits = sorted(hits, key=lambda u: (-toll[at[u]], u))[:POSITIVES]
    worth_of = {u: float(toll[at[u]]) for u in hits}
    clean = np.flatnonzero(often)
    clean = clean[np.lexsort((g.permutation(len(clean)), -often[clean]))]
    seen_of = dict(zip(bags.strings(clean[:SEARCHED]), often[clean[:SEARCHED]].tolist()))
    some = list(seen_of)
    common, rest = [u for u in some[:COMMON] if u not in worth_of], sorted(u for u in some if u not in worth_of)
    both = [u for u in worth_of if u in seen_of] + pick(sorted(_holding([u for u in some if u not in worth_of], wanted)), ALIKE)
    neg = sorted({*common, *pick(rest, DRAWN), *_inserted(common, g)})
    marks = hits[: landmarks // 4] + pick(hits[landmarks // 4 :], landmarks // 4) + common[: landmarks // 4]
    marks += pick(sorted(set(neg) - set(marks)), landmarks - len(marks))
    z = Landmarks(marks)
    values, vectors = np.linalg.eigh(z.against(marks))
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # K_zz to the power -1/2, on its range
    for again in (2, 1, 0):
        long = [u for u in worth_of if len(u) > 3]
        pos = [*worth_of, *_inserted(long, g)]
        worth = np.array([*worth_of.values(), *(worth_of[u] for u in long)]) / toxic.sum()
        x = np.concatenate([(z.against(part) @ root).astype(np.float32) for part in (pos, neg, both)])
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg) + len(both))])
        # Where strings like toxic ones are in clean texts too, the decision tends to the difference of their rates by its sum.
        other = np.array([1 + np.log2(1 + seen_of.get(u, 0)) for u in neg])
        rates = 2 * np.array([seen_of.get(u, 0) for u in both]) / toxic.sum()
        weight = np.concatenate([worth, worth.sum() * other / other.sum(), rates]) * (400 / worth.sum())
        w, bias = _svm(x, y, weight)
        machine = Machine(z.weights(root @ w), bias, none.slopes, marks)
        if again:
            hard = np.argsort(-machine.decide(rest), kind="stable")[:NEAREST]
            neg = sorted({*neg, *(rest[i] for i in hard)})
            for t in np.flatnonzero(toxic) if again == 1 else ():
                own = [u for u in bags.strings(bags.code[bags.offsets[t] : bags.offsets[t + 1]]) if len(u) > 3]
                if own and not any(u in worth_of for u in own):
                    decision = machine.decide(own)
                    if decision.max() > -0.2 and (u := own[int(decision.argmax())]) not in seen_of:
                        worth_of[u] = 1.0
    # Calibrated on the texts, and on the toxic ones once more as if the letters put in hid all but their worst unit.
    decision = np.concatenate([machine.decide(bags.units[a : a + 20_000].to_pylist()) for a in range(0, len(bags.units), 20_000)])
    rows = text_evidence(decision[bags.code], bags.offsets, bags.tokens)
    more = []
    for t in np.flatnonzero(toxic):
        own = bags.code[bags.offsets[t] : bags.offsets[t + 1]]
        if len(own) and decision[own].max() > 0:
            u = _inserted(bags.strings(own[[int(decision[own].argmax())]]), g)
            if u:
                d = machine.decide(u)
                more.append(text_evidence(d, np.array([0, 1]), bags.tokens[[t]])[0])
    rows, toxic = (np.concatenate([rows, np.array(more)]), np.append(toxic, np.ones(len(more), bool))) if more else (rows, toxic)
    machine.slopes = _platt(rows, toxic)
    return machine


def text_evidence(decision: np.ndarray, offsets: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Of each text, from the decisions of its distinct units: the highest one, the sum of the log odds of positive ones, its length.

    Columns are the highest decision (-1.5 to 1.5), that sum (at most 12), log(1 + tokens) and 1. A
    decision d near -1 to 1 stands for odds (1 + d) / (1 - d). A text without units has the lowest.
    """
    out = np.zeros((len(tokens), 4))
    out[:, 0], out[:, 2], out[:, 3] = -1.5, np.log1p(tokens), 1.0
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        begins = offsets[:-1][full]
        out[full, 0] = np.clip(np.maximum.reduceat(decision, begins), -1.5, 1.5)
        d = np.clip(decision, 0.0, 0.98)
        out[full, 1] = np.minimum(12.0, np.add.reduceat(np.log((1 + d) / (1 - d)), begins))
    return out


def _platt(x: np.ndarray, toxic: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic calibration on the columns of x by Newton steps with a little ridge."""
    p = np.zeros(x.shape[1])
    target = np.where(toxic, 1 - 1 / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        grad = x.T @ (q - target) + 1e-2 * p
        hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(len(p))
        step = np.linalg.solve(hess, grad)
        p = p - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return p


def _spelled(offsets: np.ndarray, single: np.ndarray, codes: np.ndarray, letter: list[str]) -> Iterator[tuple[int, str]]:
    """(text, string) of each run of four single letters or more."""
    alone = np.concatenate([[0], single[codes].astype(np.int8), [0]])
    step = np.diff(alone)
    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
        if b - a < 4:
            continue
        cuts = [a, *(int(o) for o in offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")]), b]
        for x, y in zip(cuts, cuts[1:]):
            if y - x >= 4:
                yield int(np.searchsorted(offsets, x, "right")) - 1, "".join(letter[c] for c in codes[x:y])


def texts_to_units(texts: pa.Array) -> tuple[np.ndarray, list[list[str]], np.ndarray, list[tuple[int, list[str]]]]:
    """(offsets of each text's tokens, units of each distinct token, distinct token of each token, spelled-out units by text)."""
    offsets, distinct, codes = split_words(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), lower=False)
    tokens = distinct.to_pylist()
    units = [units_of(t) for t in tokens]
    single = np.fromiter((len(u) == 1 and len(u[0]) == 1 for u in units), bool, len(units))
    extra = [(i, units_of(s)) for i, s in _spelled(offsets, single, codes, [u[0] if u else "" for u in units])]
    return offsets, units, codes, extra


#: What training learns from, at most about: toxic rows, other rows, bytes of their distinct strings.
TOXIC_ROWS, OTHER_ROWS, SAMPLE_BYTES = 1500, 4000, 48 << 20


def training_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(h, doc_id, toxic, tokens, units): distinct units of whole labelled texts, at most about toxic_rows and other_rows of them, chosen by a hash of doc_id.

    Texts of more than sample_bytes / 8 bytes are not learnt from. Contradictory labels of a doc_id
    count as toxic; labels without doc_id or toxic and labels of no document are passed over.
    """
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n = {r.t: r.n for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") > 0, F.lit(min(1.0, toxic_rows / max(1, n.get(True, 0))))).otherwise(F.lit(min(1.0, other_rows / max(1, n.get(False, 0)))))
    rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 20)) < share * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=2 << 20):
                offsets, units, codes, extra = texts_to_units(batch.column("text"))
                more = {}
                for i, u in extra:
                    more.setdefault(i, []).extend(u)
                out = [sorted({u for c in np.unique(codes[a:b]) for u in units[c]} | set(more.get(i, []))) for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:]))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(np.diff(offsets)), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "toxic", "tokens", "units"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes // 8)
    picked = texts.join(F.broadcast(rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"))), "doc_id")  # bounded by toxic_rows + other_rows
    return picked.mapInArrow(run, "doc_id long, toxic int, tokens long, units array<string>").select(F.xxhash64("doc_id", F.lit(4)).alias("h"), "*")


def train(sample: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Machine:
    """Fits a machine in one task on the first sample_bytes bytes of the sample in the order of its hash; the driver gets the folded table only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, toxic, tokens, used = [], [], [], 0
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                part = whole.slice(a, 256)
                strings = part.column("units").flatten()
                size = int(pc.sum(pc.binary_length(strings)).as_py() or 0) + 4 * len(strings)
                if used + size > sample_bytes:
                    continue
                used += size
                lists.append(part.column("units").take(pa.array(np.arange(part.num_rows))))
                toxic.append(np.asarray(part.column("toxic")) > 0)
                tokens.append(np.asarray(part.column("tokens")))
        if lists:
            coded = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode()
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(np.asarray(x.offsets)) for x in lists]))])
            lists.clear()
            bags = Bags(coded.dictionary, np.asarray(coded.indices), offsets, np.concatenate(tokens), np.concatenate(toxic))
        else:
            bags = Bags.of([], np.zeros(0, bool))
        m = fit(bags)
        yield pa.RecordBatch.from_arrays([pa.array([m.table.astype("<f8").tobytes()]), pa.array([m.bias]), pa.array([m.slopes]), pa.array([m.landmarks], pa.list_(pa.string()))], names=["table", "bias", "slopes", "landmarks"])

    rows = sample.repartition(1).sortWithinPartitions("h", "doc_id", F.xxhash64("units"))
    got = rows.mapInArrow(released(run), "table binary, bias double, slopes array<double>, landmarks array<string>").collect()
    if not got:  # not even an empty batch came
        return fit(Bags.of([], np.zeros(0, bool)))
    r = got[0]
    return Machine(np.frombuffer(r.table, "<f8"), r.bias, np.array(r.slopes), list(r.landmarks))


def in_fold(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the doc_id as text leaves no remainder by folds; a null doc_id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


#: Decisions that a task keeps, in units; beyond, it starts anew.
MEMORY = 200_000


class Scorer:
    """Scores batches of texts; one for each task."""

    def __init__(self, machine: Machine):
        self.machine, self.number, self.decision = machine, {}, np.zeros(0)

    def _known(self, units: list[str]) -> None:
        new = list(dict.fromkeys(u for u in units if u not in self.number))
        self.number.update(zip(new, range(len(self.decision), len(self.decision) + len(new))))
        self.decision = np.concatenate([self.decision, self.machine.decide(new)])

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[str | None]]:
        """(probability, worst unit where it is 0.5 or more) of each text."""
        if len(self.number) > MEMORY:
            self.number, self.decision = {}, np.zeros(0)
        offsets, units, codes, extra = texts_to_units(texts)
        self._known([u for us in units for u in us] + [u for _, us in extra for u in us])
        n = len(offsets) - 1
        size = np.fromiter(map(len, units), np.int64, len(units))
        flat = np.fromiter((self.number[u] for us in units for u in us), np.int64, int(size.sum()))
        begins = np.cumsum(size) - size
        best = np.full(len(units), -np.inf)
        some = np.flatnonzero(size)
        if len(some):
            best[some] = np.maximum.reduceat(self.decision[flat], begins[some])
        # Distinct (text, unit): only of tokens that count, and the best token of each text.
        token = best[codes]
        top = np.full(n, -np.inf)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            top[full] = np.maximum.reduceat(token, offsets[:-1][full])
        text = np.repeat(np.arange(n), np.diff(offsets))
        counts = np.flatnonzero((token > 0) | ((token == top[text]) & (token > -np.inf)))
        each = size[codes[counts]]
        of, at = np.repeat(text[counts], each), np.repeat(begins[codes[counts]] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        more = [(i, self.number[u]) for i, us in extra for u in us]
        pair = np.unique(np.concatenate([of * (len(self.decision) + 1) + flat[at], np.array([i * (len(self.decision) + 1) + u for i, u in more], np.int64)]))
        of, unit = pair // (len(self.decision) + 1), pair % (len(self.decision) + 1)
        rows = text_evidence(self.decision[unit], np.searchsorted(of, np.arange(n + 1)), np.diff(offsets))
        probability = self.machine.probability(rows)
        worst: list[str | None] = [None] * n
        toxic = np.flatnonzero(probability >= 0.5)
        if len(toxic):
            names = list(self.number)
            for i in toxic:
                a, b = np.searchsorted(of, [i, i + 1])
                if a < b:
                    worst[i] = names[unit[a + int(np.argmax(self.decision[unit[a:b]]))]]
        return probability, worst


def _trained(docs: DataFrame, labels: DataFrame, bounds: dict):
    """The machine, broadcast: its size is fixed."""
    machine = train(training_sample(docs, labels.where(~in_fold(F.col("doc_id"))), **bounds), bounds.get("sample_bytes", SAMPLE_BYTES))
    return docs.sparkSession.sparkContext.broadcast(machine)


def score_toxicity(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """Scores every whole text of docs (doc_id, text, ...): doc_id, held_out, score, predicted, evidence.

    Labels (doc_id, toxic) are learnt only from rows outside the held-out fold (crc32 of doc_id as
    text divisible by 5), from a bounded sample: bounds are toxic_rows, other_rows and sample_bytes
    of training_sample. The score is a calibrated function of the decisions on the text's distinct
    units (text_evidence); evidence is its worst unit, where the score is 0.5 or more. Null and
    empty texts have no unit: they get the score of the lowest decision and evidence null. With no
    label of one of the kinds every text gets the same score. Repeated rows each get a row, with
    equal scores for equal texts; contradictory labels of a doc_id count as toxic. Very long texts
    are scored whole. An empty table gives no rows; further columns, of whatever name, are ignored.
    """
    held = _trained(docs, labels, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for whole in batches:
            for batch in slices(whole, most=2 << 20):
                score, worst = scorer.score(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(worst, pa.string())], names=["doc_id", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, score double, predicted int, evidence string").select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below 0.5; see score_toxicity.

    Nulls, empty and repeated rows are judged as there: rows with equal texts stay or go together,
    an empty table stays empty, and a null doc_id does not matter.
    """
    held = _trained(docs, labels, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for whole in batches:
            for batch in slices(whole, most=2 << 20):
                yield batch.filter(pa.array(scorer.score(batch.column("text"))[0] < 0.5))

    return docs.mapInArrow(released(run), docs.schema)
