"""Training-data operators against brute force on small fixtures: nulls, empty tables, repeats, clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherlake.llm import decontaminate, imatch, language, licenses, minhash, mixing, mphf, token_counts, token_shards, toxicity, warc
from cipherlake.llm.common import staged
from cipherlake.llm.components import connected_components
from cipherlake.llm.queries import vocabulary

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "ti") for b in ("ban", "del", "fir", "gos", "hup", "jan", "kel", "lim")]


def text(g, n):
    return " ".join(g.choice(WORDS) + g.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    g = random.Random(3)
    base = text(g, 60).split()
    rows = [(i, text(g, g.randint(1, 80)), "en", f"src{i % 4}") for i in range(60)]
    for i in range(60, 80):
        w = list(base)
        w[g.randrange(60)] = "changed"
        rows.append((i, " ".join(w), "en", "src0"))
    rows += [(80, None, None, None), (81, "", "en", None), (82, " \t\n", "de", "src1"), (83, rows[0][1], "en", "src2"), (None, "no id here", "en", "src3"), (84, "one two", "fr", "src1"), (85, "word " * 5000, "en", "src2"), (86, "Été à Łódź, naïve café.", "fr", "src1")]
    return staged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n": F.lit("clash"), "key": F.lit(1), "size": F.lit(2.5)}), "docs")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_against_brute_force(docs):
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect() if r.doc_id is not None]
    low = {i: i for i, _ in rows}
    for _ in rows:
        for i, a in rows:
            for j, b in rows:
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    low[i] = min(low[i], low[j])
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, 85, rows=4).collect()}
    assert {i: r.component_id for i, r in got.items() if i is not None} == low
    assert {i: r.n_shingles for i, r in got.items() if i is not None} == {i: len(s) for i, s in rows}
    assert got[None].component_id is None and got[None].kept and all(r.kept == (i == r.component_id) for i, r in got.items() if i is not None)


def test_components_and_empty_tables(spark, docs):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (2, 2), (9, 8)], "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8}
    none = docs.limit(0)
    path = vocabulary("word_bpe_49k.json")
    for out in (minhash.near_duplicates(none), token_shards.write_and_read(none, path), token_counts.count_tokens(none, path, 49407), mixing.mix_sources(none), licenses.scan_licenses(none), imatch.imatch_fingerprints(none)):
        assert out.count() == 0


def test_token_shards_round_trip(docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in docs.collect()), key=lambda r: r[:2])
    start, want = 0, []
    for known, i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((i if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, map(tuple, token_shards.write_and_read(docs, path).collect()))) == sorted(map(str, want))


def test_perfect_hash():
    keys = np.random.default_rng(1).permutation(10**6)[:5000].astype(np.int64)
    f = mphf.MinimalPerfectHash.build(keys)
    assert sorted(f.lookup(keys)) == list(range(5000))
    index = mphf.Index(mphf.pack_index(keys, np.arange(5001), {"x": keys * 3}))
    at, found = index.find(np.concatenate([keys[:50], -keys[:50] - 1]))
    assert at.tolist() == list(range(50)) and (found["x"] == keys[:50] * 3).all()


def test_token_counts_across_blocks(docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    for block in (64, 1 << 20):
        assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path, 49407, block=block).collect()} == want


def test_mix_meets_targets(docs):
    rows = mixing.mix_sources(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.target_tokens(sizes, {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    for s in names:
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max([r["size"] for r in mine] + [1])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs).collect()))


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_mix_goes_on_after_a_document_that_does_not_fit(spark, seed):
    g = random.Random(seed)
    sizes = [30_000] * 4 + [g.randint(5_000, 9_000) for _ in range(20)] + [g.randint(20, 40) for _ in range(500)]
    docs = spark.createDataFrame([(i if i % 50 else None, f"t{i}", "s", n) for i, n in enumerate(sizes)], "doc_id long, text string, source string, n long")
    rows = mixing.mix_sources(docs, share=0.3, seed=seed, size=F.col("n"), edge_rows=0).collect()
    gap, want = round(0.3 * sum(sizes)), set()
    for r in sorted(rows, key=lambda r: (r.h % mixing.BUCKETS, r.h)):  # plain Python: every row in turn that fits
        if r["size"] <= gap:
            gap -= r["size"]
            want.add(r.h)
    assert {r.h for r in rows if r.times} == want and all(r.taken == r["size"] * r.times for r in rows)
    assert gap < min([r["size"] for r in rows if not r.times])


def test_min_cost_flow_prefers_first_passes():
    flow = mixing.min_cost_flow([(("a",), 10), (("a", "b"), 10), (("b",), 2)], {"a": 15, "b": 14}, 2)
    assert sum(f.get("a", 0) for f in flow) == 15 and sum(f.get("b", 0) for f in flow) == 14
    assert sum(max(0, sum(f.values()) - n) for f, n in zip(flow, (10, 10, 2))) == 7  # 29 wanted, 22 there once
    assert mixing.target_tokens({"a": 10, "b": 100}, {"a": 3, "b": 1}, 120) == {"a": 20.0, "b": 100.0}


def test_warc_round_trip_and_order(spark):
    pages = spark.createDataFrame([(3, "http://www.b.org/x", "same"), (1, "http://a.org/é?q=1", "same"), (2, None, None), (None, "bad url", "ä"), (7, "https://b.org:8080/y#z", ""), (1, "http://a.org/é?q=1", "same")], "page_id long, url string, html string")
    got = warc.archive_round_trip(pages.repartition(3)).collect()
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert sorted({(r.page_id or 0, r.payload_bytes, r.payload_digest) for r in got}) == sorted({(1, 4, digest(b"same")), (3, 4, digest(b"same")), (2, 0, digest(b"")), (7, 0, digest(b"")), (0, 2, digest("ä".encode()))})
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(1, "response", None), (3, "revisit", 1), (2, "response", None), (7, "revisit", 2), (None, "response", None)}
    keys = [(warc.surt(r.url), r.stamp) for r in sorted(got, key=lambda r: (r.range, r.seq))]
    assert keys == sorted(keys)


def test_loser_tree():
    g = random.Random(2)
    runs = [sorted((g.randrange(50), i) for i in range(g.randrange(20))) for _ in range(7)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r) and list(warc.LoserTree([])) == []


def test_imatch_edits(docs):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()), key=lambda r: r[:2])
    got = {r.doc_id: r for r in imatch.imatch_fingerprints(docs, high=1.0).collect()}
    for k, (known, i, x) in enumerate(rows):
        r, cut, after = got[i if known else None], len(x) // 4, rows[(k + 1) % len(rows)][2]
        assert r.n_chars == len(x) and r.edited_sha256 == hashlib.sha256((x[: len(x) - cut] + after[:cut]).encode()).hexdigest()
    assert got[0].fingerprint == got[83].fingerprint
    assert got[60].near_next > got[1].near_next


def test_successors_in_small_windows(spark):
    keys = [1, 5, 1024, 5000, 5001, 10**12, -7]
    got = {r.key: r.next for r in imatch.successors(spark.createDataFrame([(k,) for k in keys], "key long"), 2).collect()}
    assert got == dict(zip(sorted(keys), sorted(keys)[1:] + sorted(keys)[:1]))


def test_licenses(spark):
    texts = ["Licensed CC-BY, all rights reserved. General Public License", "nothing", None, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */", "cc by sa"]
    r = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert (r[0].n_words, r[0].n_base, r[0].first_word, r[0].last_word, r[0].base_labels) == (9, 3, 1, 6, "cc-by,gpl,reserved")
    assert [x.n_base for x in r] == [3, 0, 0, 0, 1] and r[1].score == 0.0 and r[2].first_word is None
    assert r[3].labels == "apache,gpl,mit" and r[4].labels == "cc-by,cc-by-sa"
    assert licenses.parse_expression("MIT AND") is None and licenses.parse_expression("(MIT") is None
    assert licenses.parse_expression("a OR b AND c WITH d") == ["or", "a", ["and", "b", ["with", "c", "d"]]]


def test_decontamination(spark, docs):
    g = random.Random(9)
    items = [(i, text(g, 25)) for i in range(5)] + [(9, None), (8, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    changed = items[2][1].split()
    changed[4] = changed[11] = "other"
    planted = spark.createDataFrame([(200, text(g, 30) + " " + items[1][1].upper() + " " + text(g, 500)), (201, " ".join(changed))], "doc_id long, text string")
    both = docs.unionByName(planted, allowMissingColumns=True)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(both, bench).collect()} == {(200, 1), (201, 2)}
    left = decontaminate.decontaminate(both, bench)
    assert left.columns == both.columns and left.count() == docs.count()
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0 == decontaminate.find_contamination(docs, bench.limit(0)).count()


def test_decontamination_scores_are_plain_tfidf_for_many_items(spark):
    g = random.Random(10)
    items = [(i, [g.choice(WORDS) + g.choice(WORDS) for _ in range(20)]) for i in range(400)]
    texts = [(i, w[:17] + g.choice(items)[1][:3]) for i, w in items]
    df = {w: sum(w in t for _, t in texts) for _, item in items for w in item}
    idf = {w: np.log((len(texts) + 1) / (n + 1)) + 0.05 for w, n in df.items()}
    vector = lambda t: {w: t.count(w) ** 0.5 * idf[w] for w in t}
    norm = lambda v: sum(x * x for x in v.values()) ** 0.5
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{key} long, text string")
    got = {r.doc_id: r.cosine for r in decontaminate.find_contamination(frame(texts, "doc_id"), frame(items, "item_id")).collect() if r.doc_id == r.item_id}
    for (i, item), (_, t) in zip(items, texts):
        a, b = vector(item), vector(t)
        assert got[i] == pytest.approx(sum(x * b.get(w, 0) for w, x in a.items()) / norm(a) / norm(b), abs=1e-4)


def test_decontamination_finds_short_and_common_items(spark):
    g = random.Random(12)
    pool = [f"common{i}" for i in range(60)]
    items = [(i, [g.choice(pool) for _ in range(n)]) for i, n in enumerate([5, 5, 6, 8, 16, 40, 90] * 3)]
    filler = lambda n: [f"filler{g.randrange(10**6)}" for _ in range(n)]
    texts = [(i, filler(100) + item + filler(100)) for i, item in items]
    texts += [(100 + i, filler(70) + [x for w in item for x in (w, *filler(1))] + filler(70)) for i, item in items]
    texts += [(200 + i, filler(20) + g.sample(pool, 15) + filler(20)) for i in range(300)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_contamination(spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string"), bench).collect()}
    for i, item in items:
        for d in (i, 100 + i):
            assert got[d, i].lcs_share == pytest.approx(1) and dict(texts)[d][got[d, i].first_word : got[d, i].end_word].count(item[0]) > 0


def reworded(g, pairs=40, items=24):
    """Documents in which the two words of a pair stand in like passages; items, and rewordings of them by the other words."""
    used = lambda i: [f"left{i}", f"right{i}"][g.randrange(2)]
    docs = [" ".join(w for _ in range(12) for w in (f"ctx{i}a", used(i), f"ctx{i}b", used(i))) for i in range(pairs) for _ in range(12)]
    out, again = [], []
    for k in range(items):
        topics = g.sample(range(pairs), 16)
        answer = [f"answer{k}x{j}" for j in range(3)]
        out.append(" ".join([f"left{i}" for i in topics] + answer))
        swap = set(g.sample(topics, 10))
        again.append(" ".join([f"filler{g.randrange(10**6)}" for _ in range(20)] + [f"{'right' if i in swap else 'left'}{i}" for i in topics] + answer))
    unlike = [" ".join(f"{g.choice(['left', 'right'])}{i}" for i in g.sample(range(pairs), 30)) for _ in range(60)]
    return docs, out, again, unlike


def test_decontamination_finds_rewordings_that_words_alone_miss(spark):
    docs, items, again, unlike = reworded(random.Random(21))
    rows = list(enumerate(again)) + [(1000 + i, t) for i, t in enumerate(docs)] + [(5000 + i, t) for i, t in enumerate(unlike)]
    frame = lambda r, key: spark.createDataFrame(r, f"{key} long, text string")
    bench = frame(list(enumerate(items)), "item_id")
    plain = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(frame(rows, "doc_id"), bench, near=2.0).collect()}
    found = decontaminate.find_contamination(frame(rows, "doc_id"), bench).collect()
    hits = {(r.doc_id, r.item_id) for r in found}
    assert not plain and len(hits & {(i, i) for i in range(len(items))}) >= 0.85 * len(items)  # 21 of 24
    assert hits <= {(i, i) for i in range(len(items))}
    assert all(r.latent >= decontaminate.NEAR and r.lcs_share < 0.6 <= r.soft_share for r in found)


def test_latent_vectors_against_a_full_decomposition(spark):
    g = np.random.default_rng(5)
    texts = [g.choice(np.arange(40) + 40 * (i % 3), 60) for i in range(90)]
    rows = spark.createDataFrame([(i, bytearray(t.astype("<u4").tobytes())) for i, t in enumerate(texts)], "doc_id long, codes binary")
    idf = np.linspace(0.5, 2, 120)
    vectors, values = decontaminate.latent_vectors(rows, np.arange(120), idf, rank=6)
    x = []
    for t in texts:
        for part in (t[:48], t[48:]):
            v = np.bincount(part, minlength=120) * idf
            x.append(v / np.linalg.norm(v))
    _, want, vt = np.linalg.svd(np.array(x), full_matrices=False)
    assert np.allclose(values[:3], want[:3], rtol=0.08)  # one pass, flat noise below
    assert np.linalg.norm(vt[:3] @ vectors[:, :3]) ** 2 > 2.8  # the three leading directions span the same space


def test_decontamination_repeats_ties_long_texts_and_clashing_columns(spark):
    g = random.Random(31)
    item = [f"w{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, " ".join(item))], "item_id long, text string")
    long = " ".join([f"f{g.randrange(10**6)}" for _ in range(30_000)] + item + ["end"] * 2000)
    rows = [(1, long), (1, long), (2, " ".join(item)), (None, " ".join(item)), (3, None), (4, ""), (5, "clean words only here, nothing else"), (None, "clean")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(7), "codes": F.lit("x"), "latent": F.lit(0.5), "_text": F.lit(1)})
    got = [(r.doc_id, r.item_id) for r in decontaminate.find_contamination(d, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 2), (2, 1), (2, 2), (None, 1), (None, 2)], key=str)
    left = decontaminate.decontaminate(d, bench)
    assert left.columns == d.columns and sorted((r.doc_id for r in left.collect()), key=str) == [3, 4, 5, None]


def test_toxicity_held_out(spark):
    g = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        w = text(g, 30).split()
        if bad := i % 3 == 0:
            w[g.randrange(30)] = g.choice(["grumpfoot", "vexhead"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "you g r u m p f o o t"), (903, "a grump-foot!"), (904, "a vexxhead"), (None, "x")]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, lab).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and sum(got[i].predicted == labels[i][1] for i in held) >= 0.95 * len(held)
    assert [got[i].predicted for i in (900, 901, 902, 903, 904)] == [0, 0, 1, 1, 1] and all(0 <= r.score <= 1 for r in got.values())
    assert {r.predicted for r in toxicity.score_toxicity(d, lab.limit(0)).collect()} == {0}
    assert toxicity.without_toxic(d, lab).columns == d.columns


def test_language(spark):
    docs = spark.createDataFrame([("the cat and the dog are here today", "en"), ("der hund und die katze sind heute hier", "de")] * 5, "text string, lang string")
    rows = spark.createDataFrame([(1, "http://x.example.de/a", None, "der hund ist hier"), (2, None, "<html lang='en'><script>der die das</script><p>the dog and cat", None), (3, None, None, None), (4, "http://x.example.de/b", None, "")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in language.identify_languages(rows, language.text_model(docs)).collect()}
    assert got[1].lang == "de" and got[2].lang == "en" and got[2].declared == "en" and got[3].lang in ("de", "en") and got[4].lang == "de" and 0 < got[4].score <= 1
