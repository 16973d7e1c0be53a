"""Spelling variants, SimHash and Merkle manifest against plain Python, with the cases their docstrings define."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cipherlake.llm import licenses, merkle, mixing, simhash, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n int, tree string"


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", 1, "y") for i, t, lang, s in rows], SCHEMA)


def odd_rows():
    g = random.Random(5)
    base = ["alpha beta gamma delta " * 3, "Alpha  beta\tgamma\ndelta\n", "", None, "   ", "one", "École École ÉCOLE naïve naive naïve", "lone\nline\n" * 4, "x" * 3000 + " " + "y" * 3000]
    vocabulary = ["".join(g.choice("abÀé÷") for _ in range(g.randint(4, 7))) for _ in range(250)]
    base += [" ".join(g.choice(vocabulary) for _ in range(g.randint(1, 120))) for _ in range(60)]
    rows = [(i, g.choice(base), g.choice(["en", None]), g.choice(["a", "a", "a", "b", "é", "ä", "", None])) for i in range(300)]
    rows += [(None, base[0], "en", "a"), (None, base[9], None, None), rows[7], rows[7], (8, "another text of id 8", "en", "a")]
    return rows


# ---- spelling variants


def plain_variants(rows):
    counts = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if apart(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def apart(a, b):
    """Exactly one edit apart, tried out."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("block", [2048, 3])
def test_variants_against_plain_python(spark, block):
    rows = odd_rows()
    got = spelling.spelling_variants(table(spark, rows), block=block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants([r[:2] for r in rows])
    assert sorted(map(tuple, got.collect())) == want and any(w[4] > 2 for w in want) and any(w[1] for w in want)


def test_variants_chain_ties_and_empty(spark):
    text = "abcdefg " * 3 + "abcdef " * 6 + "abcdeff " * 6 + "abcde " * 24 + "zzzzzzzz " * 3 + "zzzzzzz " * 7
    got = {r.word: r for r in spelling.spelling_variants(table(spark, [(1, text, "en", "a")])).collect()}
    want = plain_variants([(1, text)])
    assert sorted(map(tuple, got.values())) == want
    assert got["abcdefg"].root == "abcde" and got["abcdefg"].form == "abcdef"
    assert spelling.spelling_variants(table(spark, [])).count() == 0
    assert spelling.spelling_variants(table(spark, [(1, None, None, None), (2, "", None, None)])).count() == 0


def test_one_edit_bound_of_the_count_filter():
    g = random.Random(2)
    for _ in range(3000):
        a = "".join(g.choice("ab") for _ in range(g.randint(5, 9)))
        i, kind = g.randrange(len(a)), g.randrange(3)
        b = a[:i] + ("" if kind == 0 else g.choice("abc")) + a[i + (kind < 2) :]
        assert spelling.one_edit(a, b) == apart(a, b) == spelling.one_edit(b, a)
        if apart(a, b):
            short, long = sorted((a, b), key=len)
            assert spelling.Postings([short], len(short)).near(long) == [0]


# ---- SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    known = [(i, plain_fingerprint(t)) for i, t in rows]
    of = {}
    for i, f in known:
        if i is not None:
            of.setdefault(f, set()).add(i)
    groups = []
    for f, ids in of.items():
        joined = [g for g in groups if any((f ^ x).bit_count() <= radius for x in g[0]) or min(ids) in g[2]]
        for g in joined:
            groups.remove(g)
        groups.append(({f}.union(*(g[0] for g in joined)), ids.union(*(g[1] for g in joined)), {min(ids)}.union(*(g[2] for g in joined))))
    best = {f: min(g[1]) for g in groups for f in g[0]}
    return sorted(((i, f"{f:016x}", None if i is None else best[f]) for i, f in known), key=str)


@pytest.mark.parametrize("tile", [1 << 18, 2])
def test_simhash_against_plain_python(spark, tile):
    rows = odd_rows()
    g = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    for k in range(3):  # groups of near copies that hang together by chains only
        long = [g.choice(words) for _ in range(700)]
        for j in range(40):
            long[g.randrange(700)] = g.choice(words)
            rows.append((1000 + k * 100 + j, " ".join(long), "en", "a"))
    got = simhash.simhash_duplicates(table(spark, rows), tile=tile)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = plain_components([r[:2] for r in rows])
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(w[0] is not None and w[0] >= 1000 and w[2] != w[0] for w in want)
    assert simhash.simhash_duplicates(table(spark, [])).count() == 0


def test_tile_forest_joins_what_all_pairs_join():
    g = np.random.default_rng(4)
    x = np.concatenate([g.integers(0, 2**63, 900, dtype=np.uint64), np.uint64(7) << np.arange(60, dtype=np.uint64)])
    near = x[g.integers(0, len(x), 1500)] ^ (np.uint64(1) << g.integers(0, 64, 1500).astype(np.uint64))
    both = np.concatenate([x, near])
    near_matrix = np.bitwise_count(both[:, None] ^ both) <= 4

    def want(links):
        label = np.arange(len(both))
        while True:
            low = np.where(links, label[None, :], len(both)).min(1)
            low = np.minimum(low, label)
            if (low == label).all():
                return label
            label = low

    np.fill_diagonal(near_matrix, True)
    parts = lambda tree: {frozenset(np.flatnonzero(tree == t).tolist()) for t in np.unique(tree)}
    assert parts(simhash.tile_forest(both, None, 4)) == parts(want(near_matrix))
    across = near_matrix.copy()
    across[: len(x), : len(x)] = across[len(x) :, len(x) :] = False
    np.fill_diagonal(across, True)
    assert parts(simhash.tile_forest(x, near, 4)) == parts(want(across))


# ---- Merkle manifest


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_manifest(rows):
    marked = lambda *values: digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))
    trees = collections.defaultdict(list)
    for i, text, lang, source in rows:
        n = None if text is None else len(text)
        now = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        trees[source].append((i is not None, i or 0, marked(i, source, lang, n, text), marked(i, source, lang, n, now), i))

    def grow(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][a : a + 3])) for a in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            a = i // 3 * 3
            yield "".join(level[a:i]), "".join(level[i + 1 : a + 3])
            i //= 3

    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: grow([x[2] for x in sorted(trees[s])]) for s in order if not trees[s].sort(key=lambda x: x[:4])}
    top = grow([grown[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for j, x in enumerate(trees[s]):
            steps = [*path(grown[s], j), *path(top, k)]
            fold = x[3]
            for left, right in steps:
                fold = digest(left + fold + right)
            yield x[4], x[2], grown[s][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), fold, fold == top[-1][0]


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest_against_plain_python(spark, levels):
    rows = odd_rows() + [(5000 + i, f"text {i}\n", "en", f"s{i}") for i in range(13)]
    got = merkle.manifest(table(spark, rows), levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_manifest(rows), key=str)
    assert 0 < got.where("verified").count() < got.count()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, f"t\n{i}", "en", "a") for i in range(n)]
    got = sorted(map(tuple, merkle.manifest(table(spark, rows), levels=1).collect()))
    assert got == sorted(plain_manifest(rows))
    if n == 1:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == digest("")


def test_places_are_numbered_without_gathering_a_tree(spark, tmp_path):
    spark.range(500).select(F.when(F.col("id") % 3 == 0, F.lit("b")).otherwise(F.lit("a")).alias("tree"), (-F.col("id")).alias("k")).write.parquet(str(tmp_path / "t"))
    got = merkle.numbered(spark.read.parquet(str(tmp_path / "t")), "tree", "k").collect()
    for t in "ab":
        own = sorted((r for r in got if r.tree == t), key=lambda r: r.k)
        assert [r.pos for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}


# ---- licences: long expressions and many places


def test_expression_of_very_many_operators():
    for mark, weight in (("AND", 0.7), ("OR", 0.1)):
        labels, got = licenses.evaluate(licenses.parse_expression(f" {mark} ".join(["MIT"] * 100_000 + ["GPL-2.0"])))
        assert labels == {"mit", "gpl"} and got == weight
    assert licenses.evaluate(licenses.parse_expression("(" * 50_000 + "MIT" + ")" * 50_000)) == ({"mit"}, 0.1)
    labels, got = licenses.evaluate(licenses.parse_expression("GPL-2.0 WITH Classpath AND MIT OR Apache-2.0"))
    assert labels == {"gpl", "mit", "apache"} and got == 0.1
    assert licenses.evaluate(licenses.parse_expression("GPL-2.0 WITH Classpath")) == ({"gpl"}, 0.8 * 0.7)


def test_text_of_very_many_places(spark):
    began = time.time()
    text = "word " + "cc by " * 200_000 + "general public license cc by all rights reserved"
    chain = "SPDX-License-Identifier: " + " AND ".join(["MIT"] * 20_000)
    a, b = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, chain)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (a.n_words, a.n_base, a.first_word, a.last_word) == (400_009, 200_003, 1, 400_006) and a.base_labels == "cc-by,gpl,reserved"
    assert b.n_base == 0 and b.labels == "mit" and time.time() - began < 30


# ---- mixing: small sources near their targets, and the cost of the flow


def test_nearest_counts_against_all_choices():
    g = random.Random(3)
    for _ in range(200):
        sizes, due = [g.randint(1, 40) for _ in range(g.randint(1, 6))], g.randint(0, 300)
        sums = [0]
        for s in sizes:
            sums = [x + c * s for x in sums for c in range(3)]
        got = mixing.nearest_counts(sizes, 1, 2, due)
        assert all(0 <= c <= 2 for c in got) and abs(sum(c * s for c, s in zip(got, sizes)) - due) == min(abs(x - due) for x in sums)
    assert mixing.nearest_counts([10**7] * 60 + [1], 1, 2, 6 * 10**8 + 1)[:60] == [1] * 60


def test_small_sources_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mixing.mix_sources(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.times <= 2 and r.taken == r.size * r.times
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(1, min(r.size for r in own if r.size))
    assert sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_cost_of_the_flow_against_all_flows():
    g = random.Random(8)
    for _ in range(40):
        patterns = [(m, g.randint(1, 3)) for m in [("a",), ("b",), ("a", "b")]]
        quotas = {"a": g.randint(0, 6), "b": g.randint(0, 6)}
        best = None
        for x in range(2 * patterns[0][1] + 1):
            for y in range(2 * patterns[1][1] + 1):
                for z in range(2 * patterns[2][1] + 1):
                    for v in range(2 * patterns[2][1] - z + 1):
                        if x + z <= quotas["a"] and y + v <= quotas["b"]:
                            cost = sum(max(0, t - n) for t, (_, n) in zip((x, y, z + v), patterns))
                            best = max(best or (-1, 0), (x + y + z + v, -cost))
        taken = [sum(f.values()) for f in mixing.min_cost_flow(patterns, quotas)]
        assert (sum(taken), -sum(max(0, t - n) for t, (_, n) in zip(taken, patterns))) == best
