"""Spelling variants: words one edit apart, found in a positional q-gram index by merging postings under a count filter."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.common import ascii_lower, discard, released, staged

#: Letters of a run, and their number once A-Z are lower-cased, with the padding.
RUN = r"[A-Za-zÀ-ÿ]+"
SYMBOLS = 1 + 26 + 64
#: Letters of a gram; an edit changes as many grams of the longer word at most.
Q = 3
#: Words of one posting list that are indexed in a task at a time.
BLOCK = 2048


def variant_counts(docs: DataFrame, least_letters: int = 5, least_count: int = 3, modulus: int = 97) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, one letter deleted where `modulus` divides h = crc32("<doc_id>:<run>") (letter h % length)."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least_letters)
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.pmod(h, F.lit(modulus)) == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def gram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the padded grams of all words one after the other, and the place at which each word's begin (and the end)."""
    pad = "\x00" * (Q - 1)
    points = np.frombuffer((pad + pad.join(words) + pad).encode("utf-32-le"), np.uint32).astype(np.int64)
    symbol = np.where(points == 0, 0, np.where(points < 128, points - 96, points - 0xC0 + 27))
    code = symbol[: -Q + 1] if Q > 1 else symbol
    for j in range(1, Q):
        code = code * SYMBOLS + symbol[j : len(symbol) - Q + 1 + j]
    # Words share their paddings: the grams of one word overlap the next word's padding nowhere but in its own last ones.
    begin = np.concatenate([[0], np.cumsum([len(w) + Q - 1 for w in words])])
    return code, begin


def gram_counts(words: DataFrame) -> np.ndarray:
    """How many words hold each gram: at most SYMBOLS**Q numbers, whatever the size of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**Q, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(gram_codes(batch.column("word").to_pylist())[0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["gram", "n"])

    found = words.select("word").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**Q, np.int64)
    out[np.asarray(found.column("gram"))] = np.asarray(found.column("n"))
    return out


def routes(words: DataFrame, counts) -> DataFrame:
    """(gram, size, pos, role, word, n): the posting lists at which a word is indexed (role 3) or only asked for (role 2).

    Two words one edit apart share all but Q of the longer one's grams, at the same places or shifted by one behind the edit.
    So the rarest of the shared grams is among the Q + 1 rarest of either, in one order of (count, code, place). A word is indexed
    with its Q + 1 rarest grams under its own length; it is asked for there, and among words one letter shorter at the same place
    and the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts.value
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word").to_pylist()
            code, begin = gram_codes(words)
            of = np.repeat(np.arange(len(words)), np.diff(begin))
            code = code[: begin[-1]]
            place = np.arange(begin[-1]) - begin[of]
            order = np.lexsort((place, code, known[code], of))
            head = order[(np.arange(len(order)) - begin[of[order]]) <= Q]
            size = np.diff(begin)[of[head]] - Q + 1
            rows = [(head, 0, 0, 3), (head, 1, 0, 2), (head, 1, 1, 2)]
            at = np.concatenate([h for h, *_ in rows])
            less, shift, role = (np.repeat([r[k] for r in rows], len(head)) for k in (1, 2, 3))
            keep = place[at] >= shift
            at, less, shift, role = at[keep], less[keep], shift[keep], role[keep]
            size = np.tile(size, len(rows))[keep] - less
            taken = pa.array(of[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(code[at].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array((place[at] - shift).astype(np.int32)), pa.array(role.astype(np.int8)), batch.column("word").take(taken), batch.column("n").take(taken)],
                names=["gram", "size", "pos", "role", "word", "n"],
            )

    return words.select("word", "n").mapInArrow(released(run), "gram int, size int, pos int, role tinyint, word string, n long")


def one_edit(a: str, b: str) -> bool:
    """Whether a and b, no shorter than a by more than one letter, differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Postings:
    """Positional q-gram index over words of one length: (gram, place) to the ascending numbers of the words that hold it."""

    def __init__(self, words: list[str], size: int):
        self.words, self.size, self.lists = words, size, {}
        for i, w in enumerate(words):
            for key in self.grams(w):
                self.lists.setdefault(key, []).append(i)

    @staticmethod
    def grams(word: str) -> Iterator[tuple[str, int]]:
        padded = "\x00" * (Q - 1) + word + "\x00" * (Q - 1)
        return ((padded[p : p + Q], p) for p in range(len(word) + Q - 1))

    def near(self, word: str) -> list[int]:
        """Numbers of the words one edit away.

        A word that shares `least` of the grams shares one of any (all - least + 1) of them: the shortest lists are merged by a
        heap, and what they hold is looked up in the longer ones until the count filter is met; then it is verified.
        """
        shifts = (0,) if len(word) == self.size else (0, 1)
        least = len(word) + Q - 1 - Q
        missing, shared = len(word) + Q - 1 - least, []
        for g, p in self.grams(word):
            lists = [found for d in shifts if (found := self.lists.get((g, p - d)))]
            if lists:
                shared.append(lists)
            elif missing:
                missing -= 1
            else:
                return []
        shared.sort(key=lambda lists: sum(map(len, lists)))
        split = len(shared) - least + 1
        long = [found for lists in shared[split:] for found in lists]
        out = []
        for i, run in groupby(heapq.merge(*(found for lists in shared[:split] for found in lists))):
            count = sum(1 for _ in run)
            for found in long:
                if count >= least:
                    break
                at = bisect_left(found, i)
                count += at < len(found) and found[at] == i
            if count >= least and one_edit(self.words[i], word):
                out.append(i)
        return out


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, other, n), both ways round, once for each pair of words one edit apart; n is the other's.

    Posting lists of more than `block` words are indexed in parts by a hash of the word; whoever asks such a list asks every
    part, and is streamed past the part's index, so no list is held whole by a task.
    """
    spark = words.sparkSession
    counts = spark.sparkContext.broadcast(gram_counts(words))
    rows = staged(routes(words, counts), "routes")
    key = ["gram", "size", "pos"]
    lists = rows.groupBy(*key).agg(F.sum((F.col("role") == 3).cast("long")).alias("indexed"), F.count("*").alias("rows")).where("indexed > 0 AND rows > 1").select(*key, F.ceil(F.col("indexed") / block).cast("int").alias("parts"))
    rows = rows.join(lists, key).withColumn("mine", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(*key, "part", F.when((F.col("role") == 3) & (F.col("part") == F.col("mine")), 3).otherwise(2).cast("byte").alias("role"), "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "size", "pos", "part", "role", "word", "n"))))
        found: list[tuple] = []
        for (_, size, _, _), run_of in groupby(stream, key=lambda r: r[:4]):
            words, ns, index, asked = [], [], None, 0
            for *_, role, word, n in run_of:
                if role == 3:
                    words.append(word)
                    ns.append(n)
                    continue
                if not words:
                    break
                index = index or Postings(words, size)
                found += [(word, n, words[i], ns[i]) for i in index.near(word)]
            if len(words) > 1:
                index = index or Postings(words, size)
                found += [(words[j], ns[j], words[i], ns[i]) for j in range(len(words)) for i in index.near(words[j]) if i < j]
            if len(found) >= 20_000:
                yield _pairs(found)
                found = []
        if found:
            yield _pairs(found)

    dealt = rows.repartition(*key, "part").sortWithinPartitions(*key, "part", F.col("role").desc())
    pairs = dealt.mapInArrow(released(run), "word string, own long, other string, n long")
    both = pairs.select(F.explode(F.array(F.struct("word", "other", "n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("own").alias("n")))).alias("p")).select("p.*")
    return both.distinct()


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    word, own, other, n = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(own, pa.int64()), pa.array(other, pa.string()), pa.array(n, pa.int64())], names=["word", "own", "other", "n"])


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root): the end of each word's chain in forms (word, form), by pointers that double their reach each round."""
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        up = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, at = at, staged(at.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = not at.where("moved").isEmpty()
        at = at.drop("moved")
        if not moved:
            return at
    raise RuntimeError("the chains of forms did not end")


def spelling_variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, dominance: int = 2, block: int = BLOCK) -> DataFrame:
    """A row for each word of docs (doc_id, text, ...): word, form, root, n, n_near, form_n.

    Words are those of variant_counts; n is a word's count, n_near the number of words exactly one edit away (an inserted,
    deleted or replaced letter), form the one of largest count among them (ties: smallest in code point order) if that is at
    least `dominance` times n, else null; root the end of the chain of forms, or the word itself.

    Null and empty texts have no words; rows with a null doc_id count as rows with an empty id; repeated rows count each; texts
    and runs of any length are read whole. An empty table gives no rows; further columns are ignored. Counts are summed before the
    shuffle, so a frequent word is no hot key; `block` changes no result.
    """
    words = staged(variant_counts(docs, least_letters, least_count), "words")
    near = staged(near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best")), "near")
    of = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= dominance * F.col("n"), F.col("best")).alias("best"))
    of = staged(of.select("word", F.col("best.other").alias("form"), "n", "n_near", (-F.col("best.less")).alias("form_n")), "forms")
    ends = roots(of.where("form IS NOT NULL"))
    discard(words, near)
    return of.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
