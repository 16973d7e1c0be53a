"""Operators against plain Python, and the cases that their docstrings define: repeats, ties, empty tables, long texts, clashing columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cipherlake.llm import imatch, language, licenses, minhash, mixing, token_counts, token_shards, tokenize, toxicity, warc
from cipherlake.llm.queries import vocabulary

LETTERS = "aAbzßÄüéİıſKÅΣσςǅﬁﬀ中文字ẞµªº'’.,;:!?-–_()/\\\"1²٣̧́̈̇‍​ \t\n\x0b\x0c\r 　\U0001f600é"


def test_encoder_against_the_tokenizer():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t, e, g = Tokenizer.from_file(path), tokenize.PieceEncoder(path), random.Random(4)
    texts = ["TARİHİ. son", "Σ. ΟΔΟΣ.", "x" * 5000 + "."] + ["".join(g.choice(LETTERS) for _ in range(g.randint(0, 14))) for _ in range(20_000)]
    for a in range(0, len(texts), 500):
        ids, n = e.encode(pa.array(texts[a : a + 500]))
        want = [t.encode(x, add_special_tokens=False).ids for x in texts[a : a + 500]]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    small = tokenize.PieceEncoder(path, most=50)
    for a in range(0, 2000, 100):  # caches that turn over
        ids, _ = small.encode(pa.array(texts[a : a + 100]))
        assert ids.tolist() == [i for x in texts[a : a + 100] for i in t.encode(x, add_special_tokens=False).ids]


def test_encoder_refuses_vocabularies_that_join_spaces():
    with pytest.raises(ValueError):
        tokenize.PieceEncoder(vocabulary("byte_bpe_50k.json"))


def triples(word):
    """Gap-weighted triples by plain loops."""
    x = [toxicity.START, *(ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 33 for c in word), toxicity.END]
    out = collections.Counter()
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            for k in range(j + 1, len(x)):
                if k - i < toxicity.SPAN:
                    out[(x[i] * 64 + x[j]) * 64 + x[k]] += toxicity.DECAY ** (k - i - 2)
    norm = math.sqrt(sum(v * v for v in out.values()))
    return {t: v / norm for t, v in out.items()}


def test_subsequence_kernel_and_folding():
    words = ["idiot", "id", "idxiot", "trash", "über", "a", "longerword"]
    unit, triple, weight = toxicity.features(words)
    for i, w in enumerate(words):
        want = triples(w)
        got = dict(zip(triple[unit == i].tolist(), weight[unit == i].tolist()))
        assert got.keys() == want.keys() and all(got[t] == pytest.approx(v) for t, v in want.items())
    kernel = lambda a, b: sum(v * triples(b).get(t, 0) for t, v in triples(a).items())
    z = toxicity.Landmarks(words[:4])
    assert np.allclose(z.against(words), [[kernel(a, b) for b in words[:4]] for a in words])
    beta = np.array([0.5, -1.0, 2.0, 0.25])
    machine = toxicity.Machine(z.weights(beta), 0.125, np.zeros(4), words[:4])
    assert np.allclose(machine.decide(words), [sum(c * kernel(a, b) for c, b in zip(beta, words[:4])) + 0.125 for a in words])


def test_toxicity_cases(spark):
    g = random.Random(8)
    word = lambda: "".join(g.choice(["ka", "lo", "mi", "nu", "re", "so"]) for _ in range(3))
    rows = [(i, " ".join(["grumpfoot"] * (i % 3 == 0) + [word() for _ in range(20)])) for i in range(300)]
    labels = [(i, int(i % 3 == 0)) for i in range(300)] + [(3, 0), (6, 0), (None, 1), (7, None), (9999, 1)]
    more = [(3, rows[3][1]), (500, "clean " * 40_000 + "grumpfoot"), (501, None), (502, ""), (None, rows[3][1])]
    d = spark.createDataFrame(rows + more, "doc_id long, text string").withColumns({"toxic": F.lit(9), "score": F.lit("x"), "units": F.lit(1), "h": F.lit(2)})
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(d, lab).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(round(r.score, 9))
    assert len(got) == 305 and by[3] == by[None] and len(by[3]) == 1  # equal texts, equal scores; contradictory labels count as toxic
    assert by[501] == by[502] and max(by[501]) < 0.5 <= min(by[3])
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 300) >= 290
    left = toxicity.without_toxic(d, lab)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} >= {501, 502} and toxicity.score_toxicity(d.limit(0), lab).count() == 0


def flow(patterns, quotas, repeats):
    """The largest flow by plain augmenting paths."""
    names = list(quotas)
    cap = collections.defaultdict(int)
    for i, (members, size) in enumerate(patterns):
        cap["s", i] += repeats * size
        for m in members:
            cap[i, m] += 10**9
    for n in names:
        cap[n, "t"] += quotas[n]
    total = 0
    while True:
        via, queue = {"s": None}, ["s"]
        for u in queue:
            for (a, b), c in list(cap.items()):
                if a == u and c > 0 and b not in via:
                    via[b] = u
                    queue.append(b)
        if "t" not in via:
            return total
        path, v = [], "t"
        while via[v] is not None:
            path.append((via[v], v))
            v = via[v]
        push = min(cap[e] for e in path)
        for a, b in path:
            cap[a, b] -= push
            cap[b, a] += push
        total += push


def test_mix_of_overlapping_sources(spark):
    g = random.Random(5)
    rows = [(i, f"text {i}", "s", g.sample(["a", "b", "c"], g.randint(1, 3)), g.randint(1, 30)) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, members array<string>, n long")
    mix = lambda **o: mixing.mix_sources(d, size=F.col("n"), members=F.col("members"), **o).collect()
    got = mix()
    sizes = collections.Counter()
    groups = collections.Counter()
    for *_, m, n in rows:
        groups[tuple(sorted(m))] += n
        for s in m:
            sizes[s] += n
    names = sorted(sizes)
    targets = mixing.target_tokens(dict(sizes), dict(zip(names, (3.0, 1.0, 2.0))), 1.5 * sum(groups.values()))
    quotas = {s: round(t) for s, t in targets.items()}
    best = flow(list(groups.items()), quotas, 2)
    plan = mixing.min_cost_flow(list(groups.items()), quotas, 2)
    assert sum(sum(f.values()) for f in plan) == best
    taken = sum(r.taken for r in got)
    assert best - 30 * len(groups) <= taken <= best and all(r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mix(broadcast_rows=0)))  # the plan changes, the rows don't


def test_mixed_follows_the_mix_with_repeated_rows(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, "f g h", "x"), (3, None, "x"), (4, "", "y"), (None, "i j", "y"), (5, "k l m n", None)] + [(9, "same words here", "z")] * 7
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"row": F.lit(1), "times": F.lit("t"), "size": F.lit(2), "pattern": F.lit(0)})
    plan, out = mixing.mix_sources(d).collect(), mixing.mixed(d)
    written = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == d.columns and sum(len(t.split()) * n for (_, t), n in written.items()) == sum(r.taken for r in plan)
    assert sum(n for (i, _), n in written.items() if i == 9) == sum(r.times for r in plan if r.doc_id == 9)


def test_warc_levels_of_merging(spark, tmp_path):
    g = random.Random(6)
    rows = [(i, f"http://h{g.randrange(9)}.org/{g.randrange(40)}", f"page {i % 50}") for i in range(300)] + [(900, "http://a.org/", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"surt": F.lit("clash"), "range": F.lit(5), "digest": F.lit(0)}).repartition(9)
    folder = f"file://{tmp_path}/warc"
    runs = warc.write_archives(pages, folder)
    index = warc.merge_runs(runs, folder, ranges=3, fan_in=2)
    got = index.orderBy("range", "seq").collect()
    assert runs.count() > 4 and len(got) == 301 and [(r.surt, r.stamp) for r in got] == sorted((r.surt, r.stamp) for r in got)
    back = {r.page_id: r for r in warc.read_archives(index, folder).collect()}
    assert back[900].payload_bytes == 3_000_000 and back[7].record_type == "response" and back[57].refers_to == 7 and len(back) == 301
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_imatch_against_plain_python(spark):
    g = random.Random(2)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(g.choice(words[: 20 + 5 * (i % 21)]) for _ in range(g.randint(0, 200))) for i in range(60)] + [None, "", "Été łódź ÉTÉ", "one two", "one two"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "one two"), (None, "one two")], "doc_id long, text string").withColumns({"f": F.lit(1), "bucket": F.lit("x"), "ahead": F.lit(2)})
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    of_text = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), seed=42))
    chain = lambda x, size, seed: xxhash.xxh64_intdigest((x % 2 ** (8 * size)).to_bytes(size, "little"), seed=seed)
    terms = lambda t: {of_text(w) for w in re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower())} - {of_text("")}
    everything = texts + [texts[3], "one two", "one two"]
    df = collections.Counter(x for t in everything for x in terms(t))
    low, high, n = 0.1, 0.6, len(everything)

    def want(t):
        own = terms(t)
        band = {x for x in own if low * n <= df[x] <= high * n}
        use = band if len(band) >= 4 else own
        level = max(0, math.floor(math.log2(max(1, len(use)) / 24)))
        h = sorted(x for x in (signed(chain(7, 4, chain(x, 8, 42))) for x in use) if (x >> 4) & ((1 << level) - 1) == 0)

        def part(a):
            out = []
            for j in range(16):
                s = 42
                some = [x for x in a if x & 15 == j]
                for x in some:
                    s = chain(x, 8, s)
                out.append(f"{s:x}" if some else "-")
            return ",".join(out)

        return f"{level}:{part(h)}/{part([x for x in h if (x >> (level + 4)) & 1 == 0])}"

    got = imatch.imatch_fingerprints(d, low, high).collect()
    assert len(got) == n
    for r in got:
        assert r.fingerprint == want(texts[r.doc_id] if r.doc_id is not None else "one two")
    by = {r.doc_id: r for r in got}
    ordered = [None, None, *sorted(list(range(65)) + [3])]
    assert by[64].near_next == (1.0 if by[64].fingerprint == [r for r in got if r.doc_id is None][0].fingerprint else 0.0) and len(ordered) == n
    assert by[63].near_next == 1.0 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_language_held_out_and_clashing_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    null = F.lit(None).cast("string")
    held = docs.where(fold).select("doc_id", "lang", null.alias("url"), null.alias("html"), "text")
    got = {r.doc_id: r.lang for r in language.identify_languages(held.drop("lang"), language.text_model(docs.where(~fold))).collect()}
    want = {r.doc_id: r.lang for r in held.collect()}
    assert sum(got[i] == x for i, x in want.items()) >= 0.95 * len(want)
    model = language.text_model(docs.where(~fold))
    clash = held.limit(5).withColumns({c: F.lit("x") for c in ("host", "score", "domain", "suffix", "declared", "ll")})
    out = language.identify_languages(clash.unionByName(clash).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))), model)
    assert out.count() == 10 and out.columns[0] == "doc_id" and language.identify_languages(clash.limit(0), model).count() == 0
    long = held.limit(1).withColumn("text", F.lit("der hund und die katze " * 20_000))
    assert language.identify_languages(long, model).first().lang == "de"


def test_licences_against_plain_python(spark):
    g = random.Random(3)
    vocab = ["cc", "by", "CC", "By", "general", "public", "License", "all", "rights", "RESERVED", "x", "é", "42", "mit"]
    texts = ["".join(g.choice(vocab) + g.choice([" ", " ", "-", ", ", "\n", "/"]) for _ in range(g.randint(0, 40))) for _ in range(1500)] + [None, "", "cc by " * 30_000]
    d = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, "cc by")], "doc_id long, text string").withColumns({"labels": F.lit(1), "n_words": F.lit("x")})
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    got = licenses.scan_licenses(d).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = texts[r.doc_id] if r.doc_id is not None else "cc by"
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [(i, name) for p, name in phrases.items() for i in range(len(w) - len(p) + 1) if tuple(w[i : i + len(p)]) == p]
        assert (r.n_words, r.n_base) == (len(w), len(at)) and r.base_labels == ",".join(sorted({n for _, n in at}))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None)) and 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a b c d e f")] * 3 + [(2, "a b c d e f"), (2, "other words of this text here"), (None, "a b c d e f"), (None, "a b c d e f"), (3, None), (3, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit(1), "n_tokens": F.lit(2), "key": F.lit("k"), "sid": F.lit(0)})
    path = vocabulary("word_bpe_49k.json")
    ids = token_shards.write_and_read(d, path).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in ids) == sorted((i is not None, i or 0) for i, _ in rows)
    spans = sorted((r.start, r.n_tokens) for r in ids)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    assert sorted(r.n_tokens for r in token_counts.count_tokens(d, path, 49407).collect()) == sorted(r.n_tokens - 1 for r in ids)
    near = minhash.near_duplicates(d, 85, rows=4).collect()
    assert len(near) == len(rows) and {(r.doc_id, r.component_id) for r in near if r.doc_id == 1} == {(1, 1)} and {r.component_id for r in near if r.doc_id == 3} == {3}


def test_open_buckets_of_a_large_component(spark):
    """A bucket whose members are a large component and strays: every link is found by brute force too."""
    g = random.Random(13)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(g.choice([0, 1, 1, 2])):
            w[g.randrange(60)] = f"n{g.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in rows}
    low = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(low)
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low[a] = min(low[a], low[b])
        if low == before:
            break
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(d, 85, rows=4).collect()} == low


def test_pipeline_run_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    g = random.Random(17)
    word = lambda: "".join(g.choice(["ka", "lo", "mi", "nu", "re", "so", "ti"]) for _ in range(4))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(30)) for i in range(4)]
    clean = [(i, text(60), "en", f"s{i % 3}") for i in range(240)]
    toxic = [(300 + i, " ".join(["grumpfoot" if k == 7 else word() for k in range(40)]), "en", "s0") for i in range(80)]
    copies = [(500 + i, clean[i][1], "en", "s1") for i in range(20)]
    leaks = [(600 + i, text(20) + " " + items[i][1] + " " + text(20), "en", "s2") for i in range(4)]
    rows = clean + toxic + copies + leaks + [(700, None, "en", "s0"), (701, "", None, None), (None, text(30), "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    labels = spark.createDataFrame([(i, 0, int(300 <= i < 380)) for i in [*range(240), *range(300, 380)]], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    sf = f"file://{tmp_path}"
    got = corpus_pipeline.run(spark, sf).collect()
    # Toxic, copied and leaked documents go, the others stay; the mix decides how often, empty ones are never taken.
    left = [r for r in rows if not (r[0] is not None and (300 <= r[0] < 380 or 500 <= r[0] < 520 or 600 <= r[0] < 604))]
    kept = spark.createDataFrame(left, "doc_id long, text string, lang string, source string")
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for r in mixing.mix_sources(kept).collect():
        body = next((x for i, x, *_ in left if i == r.doc_id), None) or ""
        ids = t.encode(body, add_special_tokens=False).ids + [2]
        want += [(r.doc_id or -1, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] * r.times
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)


def test_pipeline_stages_on_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf).count() == 0
