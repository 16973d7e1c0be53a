"""Queries over the scan history derived from `orders`; SQL apart from operators.history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.operators import history
from cipherlake.plans import corpus
from cipherlake.sources.staging import fresh_path


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan an order: 50 projects, scanners by priority."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = corpus.table(spark, sf_dir, "orders").select(
        k.alias("scan_id"), F.col("o_orderdate").alias("ts"), F.concat(F.lit("p"), (c % 50).cast("string")).alias("project"), F.col("o_orderpriority").alias("scanner"), (k % 97).alias("files_scanned"), (k % 40).alias("total"), (k % 7).alias("critical"), (k % 5).alias("high"), (k % 3).alias("medium"), (k % 2).alias("low"),
        (F.floor("o_totalprice") % 101).cast("long").alias("risk"), F.col("o_orderstatus").alias("grade"), F.sort_array(F.array_distinct(F.array(*(F.get(F.array(F.lit("RSA"), F.lit("MD5"), F.lit("3DES")), ((k + i * c) % 3).cast("int")) for i in range(2))))).alias("algorithms"),
    )
    return rows


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived scans written to a history in two appends and read back."""
    folder = fresh_path(spark, "history")
    rows = scans(spark, sf_dir)
    history.append(rows.where("scan_id % 2 = 0"), folder)
    history.append(rows.where("scan_id % 2 = 1"), folder)
    return history.read(spark, folder)


def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = history.retained(_store(spark, sf_dir), 20)
    return kept.select("project", "scan_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "risk", F.array_join("algorithms", ";").alias("algorithms"))


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older JSON lines, some malformed, some with bad dates."""
    k = F.col("scan_id")
    path = F.concat(F.lit("/srv/"), F.col("project"))
    date = F.when(k % 9 == 0, F.lit("yesterday")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    line = F.to_json(F.struct(k.alias("scan_id"), date.alias("scan_date"), path.alias("scan_path"), "scanner", F.col("risk").alias("risk_score"), "grade", F.col("total").alias("total_findings"), "critical", F.lit(1).alias("unknown_key"), F.map_from_arrays("algorithms", F.transform("algorithms", lambda _: F.lit(1))).alias("algorithms")))
    lines = scans(spark, sf_dir).select(F.when(k % 11 == 0, F.concat(F.lit("{broken "), line)).otherwise(line).alias("value"))
    out = history.import_json(lines)
    return out.select("scan_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "project", "risk", "total", "critical", "high", F.array_join("algorithms", ";").alias("algorithms"))


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.newest(scans(spark, sf_dir), 10).select("project", "scan_id", "risk", "place")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "history_store": _retained,
    "history_import": _imported,
    "history_newest": _newest,
    "history_scanners": lambda spark, sf_dir: history.scanners(scans(spark, sf_dir)),
    "history_projects": lambda spark, sf_dir: history.projects(scans(spark, sf_dir)),
    "history_latest": lambda spark, sf_dir: history.latest(scans(spark, sf_dir)),
    "history_trends": lambda spark, sf_dir: history.trends(scans(spark, sf_dir), 30),
    "history_stacked": lambda spark, sf_dir: history.stacked(scans(spark, sf_dir)),
}

_SCANS = """WITH h AS (SELECT o_orderkey AS scan_id, o_orderdate AS ts, 'p' || (o_custkey % 50) AS project, o_orderpriority AS scanner, o_orderkey % 40 AS total, o_orderkey % 7 AS critical, o_orderkey % 5 AS high, o_orderkey % 3 AS medium, o_orderkey % 2 AS low,
    CAST(floor(o_totalprice) AS BIGINT) % 101 AS risk, o_orderstatus AS grade, array_to_string(list_sort(list_distinct([['RSA', 'MD5', '3DES'][1 + o_orderkey % 3], ['RSA', 'MD5', '3DES'][1 + (o_orderkey + o_custkey) % 3]])), ';') AS algorithms FROM orders),
  k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, scan_id DESC) AS k, count(*) OVER (PARTITION BY project) AS n FROM h)"""

SQL: dict[str, str] = {
    "history_store": _SCANS + " SELECT project, scan_id, strftime(ts, '%Y-%m-%d') AS day, risk, algorithms FROM k WHERE k <= 20",
    "history_import": _SCANS + " SELECT scan_id, CASE WHEN scan_id % 9 = 0 THEN '0001-01-01 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts, project, risk, total, critical, CAST(0 AS BIGINT) AS high, algorithms FROM h WHERE scan_id % 11 <> 0",
    "history_newest": _SCANS + " SELECT project, scan_id, risk, least(n, 10) - k + 1 AS place FROM k WHERE k <= 10",
    "history_scanners": _SCANS + " SELECT scanner, count(*) AS scans, CAST(floor(sum(risk) / count(*)) AS BIGINT) AS avg_risk, CAST(sum(total) AS BIGINT) AS findings, strftime(max(ts), '%Y-%m-%d') AS last_scan FROM h GROUP BY scanner",
    "history_projects": _SCANS + " SELECT project, count(*) AS scans, strftime(min(ts), '%Y-%m-%d') AS first_scan, strftime(max(ts), '%Y-%m-%d') AS last_scan FROM h GROUP BY project",
    "history_latest": _SCANS + """ SELECT a.project, a.n AS scans, a.risk, a.total, a.grade, a.risk - b.risk AS risk_delta, a.total - b.total AS total_delta, a.critical - b.critical AS critical_delta, CASE WHEN a.risk > b.risk THEN 'up' WHEN a.risk < b.risk THEN 'down' ELSE 'flat' END AS arrow
        FROM k a LEFT JOIN k b ON b.project = a.project AND b.k = 2 WHERE a.k = 1""",
    "history_trends": _SCANS + """, s AS (SELECT project, list(risk ORDER BY k DESC) AS r, list(total ORDER BY k DESC) AS t FROM k WHERE k <= 30 GROUP BY project),
        v AS (SELECT project, r, t, CASE WHEN len(r) > 20 THEN list_transform(range(0, 20), lambda i: r[CAST(1 + floor(i * len(r) / 20) AS BIGINT)]) ELSE r END AS v, list_min(r) AS lo, greatest(list_max(r) - list_min(r), 1) AS span FROM s)
        SELECT project, len(r) AS scans, CASE WHEN len(r) < 2 THEN 'unknown' WHEN r[-1] - r[1] < -5 THEN 'improving' WHEN r[-1] - r[1] > 5 THEN 'declining' ELSE 'stable' END AS direction, CASE WHEN len(r) < 2 THEN 0 ELSE r[-1] - r[1] END AS delta_risk, CASE WHEN len(r) < 2 THEN 0 ELSE t[-1] - t[1] END AS delta_findings,
          array_to_string(list_transform(v, lambda x: substr(' _.-~*=#', CAST(least(8, 1 + floor((x - lo) * 7 / span)) AS BIGINT), 1)), '') AS sparkline FROM v""",
    "history_stacked": _SCANS + " SELECT project, scan_id, 'critical' AS severity, critical AS count, CAST(0 AS BIGINT) AS base FROM h UNION ALL SELECT project, scan_id, 'high', high, critical FROM h UNION ALL SELECT project, scan_id, 'medium', medium, critical + high FROM h UNION ALL SELECT project, scan_id, 'low', low, critical + high + medium FROM h",
}
