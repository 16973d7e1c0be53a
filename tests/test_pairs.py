"""Paths between pairs against breadth-first search in plain Python."""

import random

from cipherlake.operators.pairs import pair_paths


def smallest(edges, start, finish, most):
    level = {start: (start,)}
    seen = {start}
    for depth in range(most + 1):
        if finish in level:
            return depth, ">".join(level[finish])
        ahead = {}
        for node, path in level.items():
            for to in edges.get(node, ()):
                if to not in seen and (to not in ahead or path + (to,) < ahead[to]):
                    ahead[to] = path + (to,)
        level = ahead
        seen |= set(ahead)
    return None


def test_against_plain_search(spark):
    draw = random.Random(11)
    names = [f"m{i % 40}.f{i}" for i in range(400)]
    rows = [(draw.choice(names), draw.choice(names)) for _ in range(900)] + [("m0.f0", "m0.f0"), ("m0.f0", None), (None, "x")]
    pairs = [(draw.choice(names), draw.choice(names)) for _ in range(60)] + [("m1.f1", "m1.f1"), ("gone", "m1.f1"), ("gone", "gone"), (None, "m1.f1")]
    edges = {}
    for a, b in rows:
        if a and b:
            edges.setdefault(a, set()).add(b)
    for most in (9, 3):
        got = {(r.start, r.finish): (r.depth, r.path) for r in pair_paths(spark.createDataFrame(rows * 2, "caller string, callee string"), spark.createDataFrame(pairs * 2, "start string, finish string"), most).collect()}
        want = {p: f for p in pairs if p[0] and (f := smallest(edges, *p, most))}
        assert got == want and max(d for d, _ in got.values()) <= most
    assert any(d >= 3 for d, _ in got.values()) and got[("m1.f1", "m1.f1")] == (0, "m1.f1")


def test_no_pairs(spark):
    assert pair_paths(spark.createDataFrame([("a", "b")], "caller string, callee string"), spark.createDataFrame([], "start string, finish string")).count() == 0
