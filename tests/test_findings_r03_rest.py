"""What the remaining findings of round 3 named, on small fixtures."""

import pytest

from cipherlake.functions import der
from cipherlake.operators import fixes, pairs, slicing
from cipherlake.operators.order import placed
from cipherlake.plans import certificates


def test_f11_f14_f23_narrow_rows_are_ordered(spark):
    rows = [("b.py", ".PY", 2, 0, "x / MD5", "  h = hashlib.md5(rsa.generate_private_key({3}))"), ("a.py", ".py", 9, 0, "RSA", "\trsa.generate_private_key(3)"), ("a.py", ".py", 9, 1, "RSA", "x\n  k = ec.ECDSA(h) "), ("n.py", ".py", 1, 0, None, None), ("a.go", ".go", 1, 0, "RSA", "x := 1")]
    findings = spark.createDataFrame(rows, "path string, ext string, line long, ord int, algorithm string, snippet string")
    for strict in (False, True):
        plain = fixes.ordered(fixes.suggestions(findings, strict))
        got = sorted(map(str, (r.asDict() for r in fixes.ordered_suggestions(findings, strict).select(plain.columns).collect())))
        assert got == sorted(map(str, (r.asDict() for r in plain.collect()))) and len(got) == 4
    # Places come from what was sorted and written: nothing is shuffled or sorted by range once more.
    plan = placed(spark.range(100), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "row_number" not in plan
    # Counts need no text, and tests are no argument of a generator.
    plan = fixes.tier_counts(fixes.suggestions(findings), "path")._jdf.queryExecution().optimizedPlan().toString()
    assert "REVIEW-REQUIRED" not in plan and "posexplode(both" in plan


def test_f18_f25_f27_certificates_are_made_and_read_once(spark, tmp_path):
    spark.sql("SELECT id AS o_orderkey, id % 7 AS o_custkey, timestamp'1995-03-31 10:00:00' AS o_orderdate FROM range(60)").write.parquet(str(tmp_path / "orders.parquet"))
    ready = certificates.QUERIES["certificate_readiness"](spark, str(tmp_path))
    plan = ready._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 2 and "collect_list" not in plan
    assert [(r.project, r.shor > 0) for r in ready.orderBy("project").collect()] == [(i, True) for i in range(7)]
    rows = certificates.QUERIES["certificate_findings"](spark, str(tmp_path)).collect()
    assert len(rows) == sum(not (k % 5 == 0 and p == 2) and (p == 1 or k % 4) > 0 for k in range(60) for p in range(1, k % 3 + 2))
    assert der._moment(der.UTC_TIME, b"500101000000Z") == "1950-01-01T00:00:00+00:00"
    for wrong in (b"5001 1000000Z", b"500101000060Z", b"500101000000+", b"501301000000Z"):
        with pytest.raises(ValueError):
            der._moment(der.UTC_TIME, wrong)


def test_f16_the_last_two_steps_are_no_frontiers(spark, monkeypatch):
    labels, real = [], pairs.staged
    monkeypatch.setattr(pairs, "staged", lambda df, label: labels.append(label) or real(df, label))
    edges = spark.createDataFrame([(a, b) for a, b in zip("abcdefg", "bcdefgh")] + [("a", "k"), ("k", "d"), ("a", "j"), ("j", "d"), ("h", "a")], "caller string, callee string")
    asked = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "d"), ("a", "f"), ("a", "g"), ("k", "k"), ("b", "a")], "start string, finish string")
    want = {("a", "a"): (0, "a"), ("a", "b"): (1, "a>b"), ("a", "d"): (2, "a>j>d"), ("a", "f"): (4, "a>j>d>e>f"), ("a", "g"): (5, "a>j>d>e>f>g"), ("k", "k"): (0, "k"), ("b", "a"): (7, "b>c>d>e>f>g>h>a")}
    for most in (1, 5):
        labels.clear()
        got = {(r.start, r.finish): (r.depth, r.path) for r in pairs.pair_paths(edges, asked, most).collect()}
        assert got == {k: v for k, v in want.items() if v[0] <= most}
        assert labels.count("ahead") + labels.count("back") == 2 + max(0, most - 2)


def test_f19_a_pass_is_not_run_again_by_the_next(spark):
    lines = spark.createDataFrame([("a.py", 1, 'x = "k"'), ("a.py", 2, "y = x"), ("a.py", 3, "z = y")], "path string, line long, text string")
    targets = spark.createDataFrame([("a.py", 4, v) for v in "xyzw"], "path string, line long, var string")
    found = slicing.backward_slices(lines, targets)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.var, r.value, r.source_line) for r in found.collect()) == [("x", "k", 1), ("y", "k", 1), ("z", "k", 1)]
