"""Queries of filters and merges of findings; SQL apart from operators.merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake import dims
from cipherlake.operators import merges, pyast, usage
from cipherlake.plans import code, corpus
from cipherlake.plans.frames import ctes


def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.findings(spark, sf_dir).where("NOT suppressed")


def _triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triage rows are derived from the places: every fifth is called false, with a confidence by line."""
    rows = _open(spark, sf_dir)
    triage = rows.select("file", "line", ((F.col("file") + F.col("line")) % 5 == 0).alias("is_false_positive"), (F.col("line") % 10 / 5).alias("confidence"))
    return merges.without_false_positives(rows, triage, ["file", "line"]).select("file", "line", "ord")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _open(spark, sf_dir).withColumn("description", F.col("snippet"))
    better = rows.where("line % 2 = 0").select("file", "line", F.concat(F.lit("line "), F.col("line").cast("string")).alias("description"))
    return merges.described(rows, better, ["file", "line"]).groupBy("description").agg(F.count("*").alias("n"))


def _algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merges.algorithms_of(_open(spark, sf_dir), "project")
    return out.select("project", F.array_join("algorithms", ";").alias("algorithms"), F.array_join("shor", ";").alias("shor"))


def _accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the patterns find in Python files against what their syntax trees hold."""
    found = _open(spark, sf_dir).where("language = 'Python'").groupBy("path").agg(F.collect_set("algorithm").alias("found"))
    tree = pyast.scan_sources(code.python_sources(spark, sf_dir)).groupBy("path").agg(F.collect_set("algorithm").alias("expected"))
    empty = F.array().cast("array<string>")
    return merges.accuracy(tree.join(found, "path", "full").select(F.coalesce("expected", empty).alias("expected"), F.coalesce("found", empty).alias("found")))


def _component_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Algorithms found in files whose path holds a component's name: components are the projects' folders."""
    rows = _open(spark, sf_dir).withColumn("folder", F.get(F.split("path", "/"), F.lit(0)))
    return rows.groupBy("folder").agg(F.countDistinct("algorithm").alias("algorithms"), F.countDistinct("path").alias("files"))


def _success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.success_rate(corpus.table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("outcome")), [0, 15])


PACKAGES = ["crypto/rsa", "crypto/elliptic", "crypto/ecdsa", "p256", "rsa", "paramiko"]


def _reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.reachability(corpus.source_lines(spark, sf_dir), PACKAGES)


def _infrastructure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of an infrastructure file a part."""
    texts = F.array(*(F.lit(t) for t, _ in CONFIGURED))
    lines = corpus.table(spark, sf_dir, "part").select("p_partkey", F.get(texts, (F.col("p_partkey") % len(CONFIGURED)).cast("int")).alias("text"))
    return usage.scan_infrastructure(lines).select("p_partkey", F.col("ord").cast("long").alias("ord"), "algorithm", "severity")


#: Lines of infrastructure files, and which patterns they match.
CONFIGURED = [
    ('tls_version = "TLSv1.0"', [0]), ("cipher_suites: [RC4-SHA]", [1]), ('key_algorithm = "RSA"', [2, 3]), ('resource "tls_private_key" "k" {', [4]), ("ssh-key-type: rsa", [5]), ("ENV SSL_CIPHER=RC4", [6]), ("  algorithm: ECDSA", [7]), ("min_tls_version: '1.1'", [8]), ("min_tls_version: 1.2", []), ("nothing here", []),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "triage_filter": _triaged, "enhanced_descriptions": _described, "scan_algorithms": _algorithms, "precision_recall_f1": _accuracy, "component_findings": _component_findings, "outcome_success": _success, "package_reachability": _reach, "infrastructure": _infrastructure,
}

_OPEN = ", o AS (SELECT * FROM findings WHERE NOT suppressed)"
_SHOR = ", ".join(map(dims.literal, dims.READY_SHOR))
SQL: dict[str, str] = {
    "triage_filter": ctes("findings") + _OPEN + " SELECT file, line, ord FROM o WHERE NOT ((file + line) % 5 = 0 AND (line % 10) * 10 >= 35)",
    "enhanced_descriptions": ctes("findings") + _OPEN + " SELECT CASE WHEN line % 2 = 0 THEN 'line ' || line ELSE snippet END AS description, count(*) AS n FROM o GROUP BY 1",
    "scan_algorithms": ctes("findings") + _OPEN + f", d AS (SELECT DISTINCT project, algorithm FROM o) SELECT project, string_agg(algorithm, ';' ORDER BY algorithm) AS algorithms, coalesce(string_agg(algorithm, ';' ORDER BY algorithm) FILTER (algorithm IN ({_SHOR})), '') AS shor FROM d GROUP BY project",
    "precision_recall_f1": ctes("findings") + ", " + code._values("tree", "text, algorithm, severity, category", code.TREE) + """, f AS (SELECT DISTINCT path, algorithm FROM findings WHERE NOT suppressed AND language = 'Python'), e AS (SELECT DISTINCT l.path, t.algorithm FROM lines l JOIN tree t ON t.text = l.text WHERE l.language = 'Python'),
        n AS (SELECT count(*) FILTER (e.path IS NOT NULL AND f.path IS NOT NULL) AS tp, count(*) FILTER (e.path IS NULL) AS fp, count(*) FILTER (f.path IS NULL) AS fn FROM f FULL JOIN e ON e.path = f.path AND e.algorithm = f.algorithm)
        SELECT tp, fp, fn, floor(10000 * CAST(tp AS DOUBLE) / (tp + fp) + 0.5) / 10000 AS precision_, floor(10000 * CAST(tp AS DOUBLE) / (tp + fn) + 0.5) / 10000 AS recall, floor(10000 * CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) + 0.5) / 10000 AS f1 FROM n""",
    "component_findings": ctes("findings") + _OPEN + " SELECT 'p' || project AS folder, count(DISTINCT algorithm) AS algorithms, count(DISTINCT path) AS files FROM o GROUP BY project",
    "outcome_success": "SELECT count(*) AS shots, CAST(count(*) FILTER (user_id % 16 IN (0, 15)) AS BIGINT) AS hits, floor(10000 * CAST(count(*) FILTER (user_id % 16 IN (0, 15)) AS DOUBLE) / count(*) + 0.5) / 10000 AS rate FROM events",
    "package_reachability": ctes("lines") + """, p AS (SELECT path, line, CASE WHEN contains(text, '"crypto/rsa"') THEN 'crypto/rsa' WHEN contains(text, '"crypto/elliptic"') THEN 'crypto/elliptic' WHEN starts_with(text, 'use p256') THEN 'p256' WHEN starts_with(text, 'use rsa') THEN 'rsa' END AS package FROM lines),
        i AS (SELECT DISTINCT path, line, package FROM p WHERE package IS NOT NULL), f AS (SELECT path, package, min(line) AS first FROM i GROUP BY ALL),
        c AS (SELECT f.package, count(DISTINCT (l.path, l.line)) AS calls FROM lines l JOIN f ON f.path = l.path AND l.line >= f.first WHERE regexp_matches(l.text, '(?i)(rsa|sha1|new\\s*\\(|newcipher|signingkey|privatekey|generatekey)') GROUP BY f.package),
        n AS (SELECT package, count(*) AS imports FROM i GROUP BY package), a AS (SELECT w.package, coalesce(n.imports, 0) AS imports, coalesce(c.calls, 0) AS calls FROM (SELECT unnest(['crypto/rsa', 'crypto/elliptic', 'crypto/ecdsa', 'p256', 'rsa', 'paramiko']) AS package) w LEFT JOIN n USING (package) LEFT JOIN c USING (package))
        SELECT package, imports, calls, CASE WHEN calls > 0 THEN 'CONFIRMED' WHEN imports > 0 THEN 'REACHABLE' ELSE 'AVAILABLE' END AS level, CAST(CASE WHEN calls > 0 THEN least(100, 70 + 5 * calls) WHEN imports > 0 THEN least(70, 30 + 10 * imports) ELSE 10 END AS DOUBLE) / 100 AS confidence FROM a""",
    "infrastructure": "WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {k}, {dims.literal(usage.INFRASTRUCTURE[k][1])}, {dims.literal(usage.INFRASTRUCTURE[k][2])})" for i, (_, ks) in enumerate(CONFIGURED) for k in ks) + f") AS v(i, ord, algorithm, severity)) SELECT p_partkey, CAST(ord AS BIGINT) AS ord, algorithm, severity FROM part JOIN t ON t.i = p_partkey % {len(CONFIGURED)}",
}
