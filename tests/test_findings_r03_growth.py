"""What F21, F22, F24 and F26 named, on small fixtures."""

import re
from datetime import datetime, timedelta

from cipherlake.operators import reports
from cipherlake.operators.limiter import accepts
from cipherlake.operators.match import scan_lines
from cipherlake.plans import code, corpus, streams
from cipherlake.streaming import continuous, limits

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows_of(df, *columns):
    return sorted(map(str, (r.asDict() for r in df.select(*(columns or sorted(df.columns))).collect())))


def test_f21_equal_lines_and_snippets_are_matched_once(spark):
    plain, got = scan_lines(corpus.source_lines(spark, SF)), corpus.scan(spark, SF)
    assert got.columns == plain.columns and rows_of(got) == rows_of(plain)
    assert "RLIKE" in plan_of(plain) and "RLIKE" not in plan_of(got)
    found = [("a.py", 1, 0, ".py", "MD5", "hashlib.md5(x)"), ("a.py", 2, 0, ".py", "MD5", "hashlib.md5(x)"), ("b.py", 1, 0, ".py", "RSA", "hashlib.md5(x)"), ("c.go", 1, 0, ".go", "MD5", "hashlib.md5(x)"), ("d.py", 1, 0, ".py", None, "hashlib.md5(x)"), ("e.py", 1, 0, ".py", "MD5", None), ("f", 1, 0, None, "MD5", "x")]
    fixed = reports.fixes(spark.createDataFrame(found, "path string, line long, ord int, ext string, algorithm string, snippet string"))
    assert [(r.path, r.line, r.fixed) for r in fixed.orderBy("line").collect()] == [("a.py", 1, "hashlib.sha256(x)"), ("a.py", 2, "hashlib.sha256(x)")]
    assert "regexp_replace" not in plan_of(fixed)


def test_f22_a_finding_meets_the_lines_around_it_only(spark):
    lines = spark.createDataFrame([("a", i, f"  t{i} \t") for i in range(1, 41)] + [("b", 7, "u"), (None, 1, "v"), ("d", 1, None)], "path string, line long, text string")
    findings = spark.createDataFrame([("a", 1, 0), ("a", 20, 3), ("a", 20, 4), ("a", 40, 0), ("a", 60, 0), ("b", 7, 0), ("c", 1, 0), (None, 1, 0), ("d", 1, 0), ("a", 30, None)], "path string, line long, ord int")
    got = reports.context(lines, findings)
    text = lambda at, first, last: "\n".join((">>> " if i == at else "    ") + f"{i:4d} |   t{i}" for i in range(first, last + 1))
    want = {("a", 1, 0): text(1, 1, 16), ("a", 20, 3): text(20, 5, 35), ("a", 20, 4): text(20, 5, 35), ("a", 30, None): text(30, 15, 40), ("a", 40, 0): text(40, 25, 40), ("b", 7, 0): ">>>    7 | u", ("d", 1, 0): ""}
    assert {(r.path, r.line, r.ord): r.context for r in got.collect()} == want
    assert "Join" not in plan_of(got)


def test_f24_keys_share_a_state_and_state_partitions_follow_the_cores(spark, tmp_path, monkeypatch):
    big, start = 2**53 + 1, datetime(2024, 1, 1)
    calls = [(k, big + 10 * i + j, start + timedelta(seconds=7 * i)) for i in range(12) for j, k in enumerate((None, 0, -1, 5))]
    spark.createDataFrame([*calls, (None, None, start + timedelta(days=1)), (5, None, start)], "key long, id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    limits.use_state_lists(spark)
    try:
        stream = spark.readStream.schema("key long, id long, ts timestamp").parquet(str(tmp_path / "in"))
        got = continuous.run_once(limits.accepts_stream(stream, 2, 20, "60 seconds", buckets=1), "append").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = accepts(spark.createDataFrame(calls, "key long, id long, ts timestamp").selectExpr("key", "id", "CAST(ts AS DOUBLE) AS t"), 2, 20).collect()
    assert sorted((r.id, r.key, r.t, r.accepted) for r in got) == sorted((r.id, r.key, r.t, r.accepted) for r in want) and len(got) == 48
    used = []
    monkeypatch.setattr(streams.continuous, "run_once", lambda stream, mode: used.append(spark.conf.get("spark.sql.shuffle.partitions")) or spark.range(0).selectExpr("id AS key", "true AS accepted"))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        streams.QUERIES["stream_rate_limit"](spark, SF)
        assert used == [str(2 * spark.sparkContext.defaultParallelism)] and spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_f26_python_lines_are_chosen_before_they_are_numbered(spark):
    lines = corpus.source_lines(spark, SF)
    got = corpus.source_lines(spark, SF, "Python")
    assert rows_of(got) == rows_of(lines.where("language = 'Python'")) != []
    plan = plan_of(code.python_sources(spark, SF))
    assert re.search(r"Filter [^\n]*l_orderkey#\d+L % 8\) = 0", plan[plan.index("Window") :])
