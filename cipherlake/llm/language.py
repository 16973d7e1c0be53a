"""Language identification: text likelihoods fused with declared language, address suffix and smoothed host priors by Bayes' rule."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.common import mix, slices, split_words, staged

#: Buckets of letter trigrams.
BUCKETS = 1 << 14
#: A text of many trigrams counts as this many independent ones: trigrams of a text depend on each other.
EVIDENCE = 60.0
_HIDDEN = re.compile(r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_LANG = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})")
_META = re.compile(r"(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})")


def visible_text(page: str) -> str:
    return html_lib.unescape(_HIDDEN.sub(" ", page))


def declared_language(page: str) -> str | None:
    m = _LANG.search(page) or _META.search(page)
    return m[1].lower() if m else None


def address_parts(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, domain: its last two labels, suffix: its last label); nulls where there is no host."""
    try:
        host = (urlsplit((url or "").strip()).hostname or "").lower().strip(".")
    except ValueError:
        host = ""
    if not host:
        return None, None, None
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def trigram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the hashed letter trigrams of lower-cased words, their ends included."""
    offsets, distinct, codes = split_words(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), lower=False)
    words = distinct.to_pylist()
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    letters = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64) if words else np.zeros(0, np.uint64)
    begins = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        tri = (mix((letters[:-2] * np.uint64(0x110000) + letters[1:-1]) * np.uint64(0x110000) + letters[2:]) % np.uint64(BUCKETS)).astype(np.int64) if len(letters) > 2 else np.zeros(0, np.int64)
    n = size - 2  # a word of k letters with its ends has k trigrams
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pair, count = np.unique(text * max(1, len(words)) + codes, return_counts=True) if len(codes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    text, word = pair // max(1, len(words)), pair % max(1, len(words))
    each = n[word]
    at = np.repeat(begins[word] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    return np.repeat(text, each), tri[at], np.repeat(count, each)


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities languages x BUCKETS) from all rows of docs (text, lang) with a language: counts meet by grouped aggregation."""
    langs = sorted(r.lang for r in docs.where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang")).distinct().collect())
    number = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(number), BUCKETS), np.int64)
        for whole in batches:
            for batch in slices(whole):
                of = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
                text, bucket, count = trigram_counts(batch.column("text"))
                if len(text):
                    total += np.bincount(of[text] * BUCKETS + bucket, count, total.size).astype(np.int64).reshape(total.shape)
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], names=["lang", "bucket", "n"])

    counts = np.full((len(langs), BUCKETS), 0.5)
    rows = docs.where("lang IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    for r in rows.mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.lang, r.bucket] += r.n
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def evidence(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """Adds to rows (id columns, url, html, text): host, domain, suffix, declared, ll (tempered log likelihood of each language); drops url, html, text."""
    held = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))
    ids = [c for c in rows.columns if c not in ("url", "html", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for whole in batches:
            for kind in ("html", "text"):
                mine = whole.filter(pc.is_valid(whole.column("html")) if kind == "html" else pc.is_null(whole.column("html")))
                for batch in slices(mine, kind):
                    if kind == "html":
                        pages = batch.column("html").to_pylist()
                        declared = [declared_language(p) for p in pages]
                        texts = pa.array([visible_text(p) for p in pages], pa.string())
                    else:
                        declared, texts = [None] * batch.num_rows, batch.column("text")
                    text, bucket, count = trigram_counts(texts)
                    ll = np.zeros((batch.num_rows, table.shape[1]))
                    for j in range(table.shape[1]):
                        ll[:, j] = np.bincount(text, table[bucket, j] * count, batch.num_rows)
                    n = np.bincount(text, count, batch.num_rows)
                    ll *= (EVIDENCE / (EVIDENCE + n))[:, None]
                    host, domain, suffix = zip(*map(address_parts, batch.column("url").to_pylist()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), *(pa.array(x, pa.string()) for x in (host, domain, suffix, declared)), pa.array(list(ll), pa.list_(pa.float64()))], names=[*ids, "host", "domain", "suffix", "declared", "ll"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ids)
    return rows.mapInArrow(run, f"{schema}, host string, domain string, suffix string, declared string, ll array<double>")


def _share(counts: Column, below: Column | None, strength: float, n: int) -> Column:
    """Array of smoothed shares: (counts + strength * below) / (sum + strength), below being uniform at the top."""
    base = below if below is not None else F.array_repeat(F.lit(1.0 / n), n)
    return F.transform(F.arrays_zip(counts.alias("c"), base.alias("b")), lambda x: (x["c"] + strength * x["b"]) / (F.aggregate(counts, F.lit(0.0), lambda a, v: a + v) + strength))


def identify_languages(rows: DataFrame, model: tuple[list[str], np.ndarray], strength: float = 20.0, keys: list[str] | None = None) -> DataFrame:
    """Language of each row of rows (id columns, url, html, text): ids, lang, score, text_lang, declared, host, domain, suffix.

    html (where not null) is judged by its visible text, else text. The posterior adds up the
    tempered text log likelihood, the log likelihood of the declared language and of the address
    suffix given the language, and the log prior of the host. These are grouped counts of the
    languages that the texts alone suggest, over all rows: declared and suffix by language with
    add-one smoothing; host priors smoothed towards the domain's, those towards the suffix's, those
    towards all rows', each by `strength` rows. Missing evidence is left out; a row with no text,
    no declaration and no address gets the overall prior. Repeated rows get a row each; an empty
    table gives no rows. Ties go to the first language in code point order. Null ids, urls and
    texts are kept as they are; very long texts are counted whole. The id columns are `keys`, all by
    default; columns with the names of results are not ids and are left out. The address suffix
    is the parent of the host's prior; its own likelihood counts where the host has no prior, so
    that it is not counted twice.
    """
    langs, table = model
    n = len(langs)
    ids = [c for c in (keys if keys is not None else rows.columns) if c not in ("url", "html", "text", "lang", "score", "text_lang", "declared", "host", "domain", "suffix", "ll", "post", "top")]
    rows = rows.select(*(F.col(f"`{c}`") for c in ids), *(F.col(c).cast("string").alias(c) for c in ("url", "html", "text")))
    if not n:
        return rows.select(*ids, *(F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("score", "double"), ("text_lang", "string"), ("declared", "string"), ("host", "string"), ("domain", "string"), ("suffix", "string"))))
    names = F.array(*(F.lit(x) for x in langs))
    best = lambda a: F.get(names, F.array_position(a, F.array_max(a)).cast("int") - 1)
    seen = staged(evidence(rows, langs, table), "evidence")
    seen = seen.withColumn("text_lang", best(F.col("ll")))
    sure = seen.where(F.array_max("ll") > F.array_min("ll"))  # rows with text
    counts = [F.sum((F.col("text_lang") == x).cast("double")).alias(f"n{i}") for i, x in enumerate(langs)]
    packed = F.array(*(f"n{i}" for i in range(n)))

    def grouped(by: list[str]) -> DataFrame:
        return sure.where(" AND ".join(f"{c} IS NOT NULL" for c in by)).groupBy(*by).agg(*counts).select(*by, packed.alias(f"{by[0]}_n"))

    overall = [r or 0.0 for r in sure.agg(*counts).first()]
    top = np.array(overall) + 1.0
    prior = F.array(*(F.lit(float(x)) for x in top / top.sum()))
    suffixes = grouped(["suffix"]).withColumn("suffix_p", _share(F.col("suffix_n"), prior, strength, n))
    domains = grouped(["domain", "suffix"]).join(suffixes.select("suffix", "suffix_p"), "suffix").withColumn("domain_p", _share(F.col("domain_n"), F.col("suffix_p"), strength, n)).select("domain", "domain_p")
    hosts = grouped(["host", "domain"]).join(domains, "domain").withColumn("host_p", _share(F.col("host_n"), F.col("domain_p"), strength, n)).select("host", "host_p")
    whole = F.array(*(F.lit(float(x)) for x in top))

    def likelihood(column: str, kinds: int) -> Column:
        """P(value | language) with add-one smoothing over the kinds of values."""
        return F.transform(F.arrays_zip(F.col(column).alias("c"), whole.alias("w")), lambda x: F.log((x["c"] + 1.0) / (x["w"] + float(kinds))))

    declared = grouped(["declared"])
    n_declared, n_suffix = declared.count() + 1, suffixes.count() + 1
    declared = declared.select("declared", likelihood("declared_n", n_declared).alias("declared_ll"))
    suffix_ll = suffixes.select("suffix", likelihood("suffix_n", n_suffix).alias("suffix_ll"))
    out = seen.join(hosts, "host", "left").join(declared, "declared", "left").join(suffix_ll, "suffix", "left")
    # The suffix is a parent of the host prior; where the host is known it is not counted again.
    at = lambda c, i, d=0.0: F.coalesce(F.get(F.col(c), F.lit(i)), F.lit(d))
    post = F.array(*(at("ll", i) + at("declared_ll", i) + F.when(F.col("host_p").isNull(), at("suffix_ll", i)).otherwise(0.0) + F.log(F.coalesce(F.get("host_p", F.lit(i)), F.get(prior, F.lit(i)))) for i in range(n)))
    out = out.withColumn("post", post).withColumn("top", F.array_max("post"))
    score = 1.0 / F.aggregate("post", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    return out.select(*ids, best(F.col("post")).alias("lang"), score.alias("score"), "text_lang", "declared", "host", "domain", "suffix")
