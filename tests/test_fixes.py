"""Fix suggestions of both tiers, and places in a total order."""

from cipherlake.operators import fixes
from cipherlake.operators.order import placed

COLUMNS = "path string, ext string, line long, ord int, algorithm string, snippet string"


def test_both_tiers_for_one_finding_and_their_order(spark):
    rows = spark.createDataFrame([("b.py", ".py", 2, 0, "MD5", "h = hashlib.md5(rsa.generate_private_key(3))"), ("a.py", ".py", 9, 0, "RSA", "rsa.generate_private_key(3)"), ("a.go", ".go", 1, 0, "RSA", "x := 1")], COLUMNS)
    got = [(r.place, r.tier, r.path, r.algorithm_after) for r in fixes.ordered(fixes.suggestions(rows)).orderBy("place").collect()]
    assert got == [(1, 1, "b.py", "SHA-256"), (2, 2, "a.py", "ML-KEM-768 (hybrid)"), (3, 2, "b.py", "ML-KEM-768 (hybrid)")]
    counts = fixes.tier_counts(fixes.suggestions(rows)).first()
    assert (counts.suggestions, counts.tier1, counts.tier2) == (3, 1, 2)


def test_template_keeps_indentation_and_doubles_braces(spark):
    rows = spark.createDataFrame([("a.py", ".py", 1, 0, "DSA", "    k = dsa.generate_private_key({1: 2}) ")], COLUMNS)
    lines = fixes.suggestions(rows).first().fixed.split("\n")
    assert all(line.startswith("    ") and not line.startswith("     ") for line in lines)
    assert lines[1] == "    # Original: k = dsa.generate_private_key({{1: 2}})" and 'Signature("ML-DSA-65")' in lines[3]
    assert 'Signature("ML-DSA-87")' in fixes.suggestions(rows, strict=True).first().fixed


def test_algorithm_must_be_named_whole(spark):
    rows = spark.createDataFrame([("a.py", ".py", 1, 0, "SHA-256", "hashlib.sha1(x)"), ("a.py", ".py", 2, 0, "md5 / SHA-1", "hashlib.sha1(x)"), ("a.py", ".py", 3, 0, "MD5", "HASHLIB.MD5(x)"), ("a.py", None, 4, 0, None, None)], COLUMNS)
    assert [(r.line, r.algorithm_before) for r in fixes.suggestions(rows).collect()] == [(2, "SHA-1")]


def test_places_over_many_ranges_with_ties_and_nulls(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 7 > 0 THEN id % 7 END AS a", "id DIV 2 AS b")
    got = placed(rows, "a", "b").orderBy("place").collect()
    want = sorted(((i % 7 if i % 7 else -1, i // 2) for i in range(5000)))
    assert [r.place for r in got] == list(range(1, 5001))
    assert [(-1 if r.a is None else r.a, r.b) for r in got] == want
    assert placed(rows.limit(0), "a", "b").count() == 0
