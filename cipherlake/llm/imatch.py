"""I-Match document fingerprints with randomised lexicons, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cipherlake.llm.common import discard, staged

#: Bits of the lexicon's filter for each term in it, and bits set for a term.
FILTER_BITS, FILTER_HASHES = 32, 3
#: Documents whose ids share all but so many low bits are ordered in one window; a bucket holds 1,024 ids at most.
RANGE_BITS = 10
#: Up to so many ordered keys a single window is used; above, keys are grouped first.
ONE_WINDOW = 100_000
#: A fingerprint has 2**SUBSET_BITS hashes at each of two rates.
SUBSET_BITS = 4
#: xxhash64 of an empty array is its seed.
EMPTY = 42


def term_ids(text: Column) -> Column:
    """Distinct terms of a text: 64-bit hashes of its lower-cased words."""
    return F.array_remove(F.array_distinct(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _places(term: Column, bits: int) -> list[Column]:
    """The places of a term in a filter of 2**bits bits: disjoint parts of its hash."""
    return [F.call_function("shiftright", term, F.lit(20 * i)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for i in range(FILTER_HASHES)]


def lexicon(docs: DataFrame, low: float, high: float) -> Callable[[Column], Column]:
    """Whether a term's document share lies in [low, high], that is -ln(high) <= idf <= -ln(low), as a function of the term.

    Shares are counted for every whole term over every document. As at most (mean distinct terms of
    a document) / low terms reach the share low, the lexicon has a bound that doesn't grow with the
    corpus; it goes into the plan as a constant filter of FILTER_BITS to 2 * FILTER_BITS bits a term,
    2**24 in all at most. A term outside the band passes by chance with a probability below one in a
    thousand while the lexicon has up to 500,000 terms, and then passes in every document alike.
    """
    n = docs.count()
    df = docs.select(F.explode(term_ids(F.col("text"))).alias("t")).groupBy("t").count().where((F.col("count") >= F.lit(low * n)) & (F.col("count") <= F.lit(high * n)))
    band = staged(df.select("t"), "lexicon")
    bits = max(10, min(24, (FILTER_BITS * max(1, band.count())).bit_length()))
    words = band.select(F.explode(F.array(*_places(F.col("t"), bits))).alias("p")).groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p") % 64)).alias("w")).collect()
    discard(band)
    flat = [0] * (1 << (bits - 6))
    for r in words:
        flat[r.i] = r.w
    table = F.split(F.lit(",".join(map(str, flat))), ",").cast("array<bigint>")

    def inside(term: Column) -> Column:
        found = [F.getbit(F.get(table, F.shiftright(p, 6)), p % 64) == 1 for p in _places(term, bits)]
        return found[0] & found[1] & found[2]

    return inside


def fingerprint(text: Column, lex: Callable[[Column], Column]) -> Column:
    """struct(level, fine, coarse): hashes of the sorted distinct terms of 2**SUBSET_BITS random sub-lexicons at two sampling rates.

    A term's hash puts it into one of the sub-lexicons, or with growing level into none: at level c
    a sub-lexicon holds one in 2**(SUBSET_BITS + c) terms. A text of m lexicon terms has the level
    c = floor(log2(m / (1.5 * 2**SUBSET_BITS))), 0 at least, so that 1.5 to 3 of its terms are
    expected in each `coarse` sub-lexicon and half as many in each `fine` one, a subset of it.
    A text with fewer than four lexicon terms uses all its terms.
    """
    k = 1 << SUBSET_BITS
    terms = term_ids(text)
    # Each step is bound once by a transform over one element, so nothing is evaluated twice.
    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    shift = lambda h, n: F.call_function("shiftright", h, n)
    mask = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1

    def hashes(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.xxhash64(F.filter(a, lambda h: h.bitwiseAND(F.lit(k - 1)) == j)))

    def of_terms(a: Column) -> Column:
        level = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.size(a), F.lit(1)) / (1.5 * k)))).cast("int")
        picked = bind(level, lambda c: F.struct(c.alias("level"), F.array_sort(F.filter(F.transform(a, lambda t: F.xxhash64(t, F.lit(7))), lambda h: shift(h, F.lit(SUBSET_BITS)).bitwiseAND(mask(c)) == 0)).alias("h")))
        return bind(picked, lambda s: F.struct(s["level"].alias("level"), hashes(s["h"]).alias("coarse"), hashes(F.filter(s["h"], lambda h: shift(h, s["level"] + SUBSET_BITS).bitwiseAND(F.lit(1)) == 0)).alias("fine")))

    both = bind(terms, lambda a: F.struct(a.alias("all"), F.filter(a, lex).alias("band")))
    return bind(bind(both, lambda s: F.when(F.size(s["band"]) >= 4, s["band"]).otherwise(s["all"])), of_terms)


def fingerprint_text(f: Column) -> Column:
    """level:coarse hashes/fine hashes, with - for a subset without terms."""
    part = lambda a: F.array_join(F.transform(a, lambda h: F.when(h == EMPTY, F.lit("-")).otherwise(F.lower(F.hex(h)))), ",")
    return F.concat(f["level"].cast("string"), F.lit(":"), part(f["coarse"]), F.lit("/"), part(f["fine"]))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that are not empty on both sides, at the finest common rate; 1 for equal fingerprints."""

    def share(x: Column, y: Column) -> Column:
        same = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p == q) & (p != EMPTY)), lambda v: v))
        some = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p != EMPTY) | (q != EMPTY)), lambda v: v))
        return F.when(some == 0, F.lit(0.0)).otherwise(same / some)

    return (
        F.when((a["level"] == b["level"]) & (a["coarse"] == b["coarse"]) & (a["fine"] == b["fine"]), F.lit(1.0))
        .when(a["level"] == b["level"], share(a["fine"], b["fine"]))
        .when(a["level"] + 1 == b["level"], share(a["fine"], b["coarse"]))
        .when(a["level"] == b["level"] + 1, share(a["coarse"], b["fine"]))
        .otherwise(F.lit(0.0))
    )


def successors(keys: DataFrame, one_window: int = ONE_WINDOW) -> DataFrame:
    """(key, next): the next larger of the distinct keys, the smallest for the largest. No window holds more than one_window rows."""
    if keys.count() <= one_window:
        return keys.select("key", F.coalesce(F.lead("key").over(W.orderBy("key")), F.min("key").over(W.partitionBy(F.lit(0)))).alias("next"))
    grouped = keys.withColumn("g", F.shiftright("key", RANGE_BITS))
    firsts = staged(grouped.groupBy("g").agg(F.min("key").alias("first")), "firsts")
    after = successors(firsts.select(F.col("g").alias("key")), one_window).join(firsts.select(F.col("g").alias("next"), "first"), "next").select(F.col("key").alias("g"), "first")
    return grouped.withColumn("in_group", F.lead("key").over(W.partitionBy("g").orderBy("key"))).join(after, "g").select("key", F.coalesce("in_group", "first").alias("next"))


def with_next(rows: DataFrame, columns: list[str], one_window: int = ONE_WINDOW) -> DataFrame:
    """Adds next_<c> of each column: its value in the next row in ascending doc_id order (nulls first, ties by a hash of the text), after the last the first.

    Rows meet in windows of neighbouring ids, those without an id in windows of neighbouring hashes
    of the text, so that many of them are no hot window; the first row of each window is also put,
    marked, at the end of the window before it.
    """
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-(1 << 62)) + F.shiftright("tie", 44)).otherwise(F.shiftright("doc_id", RANGE_BITS)))
    buckets = staged(rows.select(F.col("bucket").alias("key")).distinct(), "buckets")
    order = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.col("tie"))
    firsts = rows.groupBy("bucket").agg(F.min_by(F.struct(*columns), order).alias("f"))
    ahead = successors(buckets, one_window).join(firsts.withColumnRenamed("bucket", "next"), "next").select(F.col("key").alias("bucket"), "f.*")
    both = rows.withColumn("ahead", F.lit(0)).unionByName(ahead.withColumn("ahead", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy("bucket").orderBy("ahead", F.col("doc_id").asc_nulls_first(), "tie")
    return both.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns)).where("ahead = 0").drop("bucket", "tie", "ahead")


def imatch_fingerprints(docs: DataFrame, low: float = 0.001, high: float = 0.25) -> DataFrame:
    """Fingerprints of each text of docs (doc_id, text, ...) and of its edited text; see the columns below.

    doc_id, n_chars (code points), edited_sha256 (of the text whose last floor(n_chars / 4) code
    points are replaced by as many, or all, of the next document's first), fingerprint,
    edited_fingerprint, near_edited and near_next (likeness of the fingerprint to the edited
    text's and to the next document's, 0 to 1).

    Null counts as empty. Two texts without words have equal, empty fingerprints (likeness 1).
    Equal texts have equal fingerprints; repeated rows keep a row each. A single document is its
    own next. An empty table gives no rows; further columns, of whatever name, are ignored; very
    long texts are hashed whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lex = lexicon(docs, low, high)
    rows = with_next(docs.withColumn("f", fingerprint(F.col("text"), lex)), ["text", "f"])
    n, cut = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "f", "next_f", fingerprint(F.col("edited"), lex).alias("e"))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("f")).alias("fingerprint"), fingerprint_text(F.col("e")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"))
