"""Queries against their SQL on the smallest tables, without the training-data subpackage."""

import duckdb
import pytest

from cipherlake.operators.graph import shortest_levels
from cipherlake.operators.limiter import accepts
from cipherlake.operators.match import scan_lines, scan_rules
from cipherlake.plans import catalog

SF = "/root/testdata/sf0.001"
SOME = ["scan_findings", "risk_score_by_file", "baseline_new", "qars_overall", "readiness_grade", "compliance_rows", "dep_findings", "latest_delta", "callgraph_bfs", "fix_tier1", "bb84_qber", "session_activity"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in catalog.DRIVER_TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    found = db.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    names = sorted(columns)
    assert sorted(df.columns) == names
    want = sorted(str([plain(dict(zip(columns, r))[c]) for c in names]) for r in found.fetchall())
    got = sorted(str([plain(r[c]) for c in names]) for r in df.collect())
    assert got == want and got


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_limiter_keeps_no_trace_of_rejected_calls(spark):
    calls = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 1, 2, 60, 61, 62])], "key long, id long, t double")
    assert [r.accepted for r in accepts(calls, 2, 60).orderBy("id").collect()] == [True, True, False, False, True, True]


def test_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "caller string, callee string")
    got = {r.node: r.depth for r in shortest_levels(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 1}


def test_scans(spark):
    lines = spark.createDataFrame([("Python", "k = rsa.generate_private_key(65537)"), ("Python", "# hashlib.md5(x)"), ("Go", "x := 1"), ("Python", "t(algorithm='RS256')"), ("Python", "t(algorithm='RS256')" + " " * 3000)], "language string, text string")
    assert [(r.algorithm, r.severity) for r in scan_lines(lines).collect()] == [("RSA", "CRITICAL")]
    assert [r.rule_id for r in scan_rules(lines).collect()] == ["pqc-jwt-rsa"]
