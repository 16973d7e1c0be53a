"""Queries of scores, grades, gates and frameworks; their SQL is written from the survey's rules, apart from operators.scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.operators import scoring
from cipherlake.plans import corpus
from cipherlake.plans.frames import ctes

#: Dates of judgement: today in the survey's probes, a year with urgent deadlines, and one with overdue ones.
AS_OF, URGENT, OVERDUE = "2026-03-23", "2030-06-01", "2031-06-01"


def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.findings(spark, sf_dir).where("NOT suppressed").withColumn("description", F.col("snippet"))


def _qars_by_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.qars_by_algorithm(_open(spark, sf_dir)).select("project", "algorithm", "n", scoring.rounded(F.col("risk"), 6).alias("risk"))


def _qars(**years) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scoring.qars(_open(spark, sf_dir), **years).select("project", scoring.rounded(F.col("score"), 3).alias("qars"), "grade")

    return run


def _highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.qars(_open(spark, sf_dir)).select("project", F.col("highest_risk_algo").alias("algorithm"))


def _readiness(as_of: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = scoring.rounded
        rows = scoring.readiness(_open(spark, sf_dir), as_of)
        return rows.select("project", "shor", "grover", "overdue", "urgent", "violations", *(r(F.col(c)).alias(c) for c in ("algorithm_score", "key_score", "compliance_score", "score")), "grade")

    return run


def _gates(as_of: str) -> Callable[[SparkSession, str], DataFrame]:
    names = ["pqc-ready", "no-critical", "cnsa-compliant", "migration-safe", "no-such-gate"]
    return lambda spark, sf_dir: scoring.gate_results(_open(spark, sf_dir), as_of, names)


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.gate_conditions(_open(spark, sf_dir), AS_OF).select("project", "gate", "condition", "actual", "passed")


def _countdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.deadlines(_open(spark, sf_dir), AS_OF)
    return rows.select("project", "algorithm", "category", "deadline", "days", "urgency")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "qars_by_algorithm": _qars_by_algorithm,
    "qars_overall": _qars(),
    "qars_restricted": _qars(sensitivity="restricted", exposure="critical_infra", shelf=20, migration=5, threat=10),
    "highest_risk_algo": _highest,
    "readiness_grade": _readiness(AS_OF),
    "readiness_urgent": _readiness(URGENT),
    "readiness_overdue": _readiness(OVERDUE),
    "gate_results": _gates(AS_OF),
    "gate_results_overdue": _gates(OVERDUE),
    "gate_conditions": _conditions,
    "compliance_rows": lambda spark, sf_dir: scoring.compliance(_open(spark, sf_dir), AS_OF),
    "framework_verdict": lambda spark, sf_dir: scoring.verdicts(_open(spark, sf_dir)),
    "deadline_countdown": _countdown,
    "risk_score_by_project": lambda spark, sf_dir: scoring.risk_score(_open(spark, sf_dir)),
}

_OPEN = ", o AS (SELECT *, file * 1000000 + line * 100 + ord AS pos FROM findings WHERE NOT suppressed)"


def _risk(sensitivity: float, exposure: float) -> str:
    return f""", firsts AS (SELECT project, algorithm, count(*) AS n, min(pos) AS first_at, arg_min(snippet, pos) AS d FROM o GROUP BY project, algorithm),
    sized AS (SELECT *, TRY_CAST(regexp_extract(d, 'key_size=([^) ]*)', 1) AS BIGINT) AS size FROM firsts),
    risk AS (SELECT s.*, least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) * coalesce(b.base, CAST(0.5 AS DOUBLE))
        + CAST(0.2 AS DOUBLE) * (CASE WHEN size IS NULL THEN CAST(0.7 AS DOUBLE) WHEN z.factor IS NULL THEN CAST(0.5 AS DOUBLE) ELSE z.factor END)
        + CAST(0.15 AS DOUBLE) * CAST({sensitivity} AS DOUBLE) + CAST(0.15 AS DOUBLE) * CAST({exposure} AS DOUBLE)) AS risk
      FROM sized s LEFT JOIN base_risk b USING (algorithm) LEFT JOIN size_risk z USING (size))"""


def _overall(factor: str) -> str:
    return f""", overall AS (SELECT project, least(CAST(100 AS DOUBLE), sum(CAST(floor(risk * 1000000 + 0.5) AS BIGINT) * n) / CAST(sum(n) AS DOUBLE) / 1000000 * CAST({factor} AS DOUBLE) * 100) AS q FROM risk GROUP BY project),
    graded AS (SELECT project, q, CASE WHEN q < 20 THEN 'A' WHEN q < 40 THEN 'B' WHEN q < 60 THEN 'C' WHEN q < 80 THEN 'D' ELSE 'F' END AS grade FROM overall)"""


def ready_sql(as_of: str) -> str:
    return f""", marked AS (SELECT o.*, algorithm IN (SELECT algorithm FROM ready_shor) AS is_shor, algorithm IN (SELECT algorithm FROM ready_grover) AS is_grover,
        TRY_CAST(regexp_extract(snippet, 'key_size=([^) ]*)', 1) AS BIGINT) AS size FROM o),
    counted AS (SELECT project, count(*) AS total, count(*) FILTER (is_shor) AS shor, count(*) FILTER (is_grover) AS grover, count(*) FILTER (severity = 'CRITICAL') AS criticals,
        30 * count(*) FILTER (algorithm = 'RSA' AND size < 2048) + 10 * count(*) FILTER (algorithm = 'RSA' AND size >= 2048 AND size < 4096)
        + 15 * count(*) FILTER (contains(upper(snippet), 'ECB')) + 5 * count(*) FILTER (category = 'certificate') AS loss,
        bool_or(algorithm = 'MD5') AS md5, bool_or(algorithm = 'RC4') AS rc4, bool_or(algorithm = '3DES') AS des3 FROM marked GROUP BY project),
    due AS (SELECT p.project, p.algorithm, c.status, date_diff('day', DATE '{as_of}', CAST(d.deadline AS DATE)) AS days
      FROM (SELECT DISTINCT project, algorithm FROM o) p JOIN compliance c ON c.algorithm = p.algorithm AND c.framework = 'CNSA 2.0' JOIN deadlines d ON d.deadline_key = c.deadline_key),
    late AS (SELECT project, count(*) FILTER (days < 0) AS overdue, count(*) FILTER (days >= 0 AND days < 365) AS urgent, count(*) FILTER (status = 'NON-COMPLIANT') AS violations FROM due GROUP BY project),
    parts AS (SELECT c.*, coalesce(l.overdue, 0) AS overdue, coalesce(l.urgent, 0) AS urgent, coalesce(l.violations, 0) AS violations,
        CASE WHEN shor > 0 THEN greatest(CAST(0 AS DOUBLE), 40 - CAST(shor AS DOUBLE) / total * 40 - 2 * grover) WHEN grover > 0 THEN greatest(CAST(0 AS DOUBLE), CAST(70 - 3 * grover AS DOUBLE)) ELSE CAST(100 AS DOUBLE) END AS a,
        CAST(greatest(0, 100 - loss - CASE WHEN md5 THEN 20 ELSE 0 END - CASE WHEN rc4 THEN 20 ELSE 0 END - CASE WHEN des3 THEN 10 ELSE 0 END) AS DOUBLE) AS k FROM counted c LEFT JOIN late l USING (project)),
    whole AS (SELECT *, CAST(greatest(0, 100 - 20 * overdue - 10 * urgent - 5 * violations) AS DOUBLE) AS f FROM parts),
    capped AS (SELECT *, least(CAST(0.4 AS DOUBLE) * a + CAST(0.3 AS DOUBLE) * k + CAST(0.3 AS DOUBLE) * f, CASE WHEN overdue > 0 THEN CAST(59 AS DOUBLE) WHEN shor > 0 OR md5 OR rc4 THEN CAST(74 AS DOUBLE) ELSE CAST(100 AS DOUBLE) END) AS score FROM whole),
    ready AS (SELECT *, CASE WHEN score < 40 THEN 'F' WHEN score < 60 THEN 'D' WHEN score < 75 THEN 'C' WHEN score < 85 THEN 'B' WHEN score < 95 THEN 'A' ELSE 'A+' END AS grade FROM capped)"""


_R1 = "floor({0} * 10 + 0.5) / 10"
_READY_TABLES = ctes("findings", "ready_shor", "ready_grover", "compliance", "deadlines", "base_risk", "size_risk") + _OPEN
READY_GRADES = f"SELECT project, shor, grover, overdue, urgent, violations, {_R1.format('a')} AS algorithm_score, {_R1.format('k')} AS key_score, {_R1.format('f')} AS compliance_score, {_R1.format('score')} AS score, grade FROM ready"
_GATES = """SELECT project, 'pqc-ready' AS gate, shor = 0 AND grade NOT IN ('F', 'D') AND overdue = 0 AS passed FROM ready
    UNION ALL SELECT project, 'no-critical', criticals = 0 FROM ready
    UNION ALL SELECT project, 'cnsa-compliant', overdue = 0 AND violations = 0 FROM ready
    UNION ALL SELECT r.project, 'migration-safe', r.grade <> 'F' AND floor(g.q * 10 + 0.5) / 10 < 80 FROM ready r JOIN graded g ON g.project = r.project
    UNION ALL SELECT project, 'no-such-gate', false FROM ready"""
_RISK_TABLES = ctes("findings", "base_risk", "size_risk") + _OPEN

SQL: dict[str, str] = {
    "qars_by_algorithm": _RISK_TABLES + _risk(0.4, 0.8) + " SELECT project, algorithm, n, floor(risk * 1000000 + 0.5) / 1000000 AS risk FROM risk",
    "qars_overall": _RISK_TABLES + _risk(0.4, 0.8) + _overall("1.15") + " SELECT project, floor(q * 1000 + 0.5) / 1000 AS qars, grade FROM graded",
    "qars_restricted": _RISK_TABLES + _risk(1.0, 1.0) + _overall("1.5") + " SELECT project, floor(q * 1000 + 0.5) / 1000 AS qars, grade FROM graded",
    "highest_risk_algo": _RISK_TABLES + _risk(0.4, 0.8) + ", ranked AS (SELECT project, algorithm, row_number() OVER (PARTITION BY project ORDER BY floor(risk * 1000000 + 0.5) DESC, first_at) AS k FROM risk) SELECT project, algorithm FROM ranked WHERE k = 1",
    "readiness_grade": _READY_TABLES + ready_sql(AS_OF) + " " + READY_GRADES,
    "readiness_urgent": _READY_TABLES + ready_sql(URGENT) + " " + READY_GRADES,
    "readiness_overdue": _READY_TABLES + ready_sql(OVERDUE) + " " + READY_GRADES,
    "gate_results": _READY_TABLES + ready_sql(AS_OF) + _risk(0.4, 0.8) + _overall("1.15") + " " + _GATES,
    "gate_results_overdue": _READY_TABLES + ready_sql(OVERDUE) + _risk(0.4, 0.8) + _overall("1.15") + " " + _GATES,
    "gate_conditions": _READY_TABLES + ready_sql(AS_OF) + _risk(0.4, 0.8) + _overall("1.15") + """ SELECT project, 'pqc-ready' AS gate, 'no_shor' AS condition, CAST(shor AS VARCHAR) AS actual, shor <= 0 AS passed FROM ready
        UNION ALL SELECT project, 'pqc-ready', 'grade_c', grade, grade IN ('C', 'B', 'A', 'A+') FROM ready
        UNION ALL SELECT project, 'pqc-ready', 'no_overdue', CAST(overdue AS VARCHAR), overdue <= 0 FROM ready
        UNION ALL SELECT project, 'no-critical', 'no_crit', CAST(criticals AS VARCHAR), criticals <= 0 FROM ready
        UNION ALL SELECT project, 'cnsa-compliant', 'no_overdue', CAST(overdue AS VARCHAR), overdue <= 0 FROM ready
        UNION ALL SELECT project, 'cnsa-compliant', 'no_non_compliant', CAST(violations AS VARCHAR), violations <= 0 FROM ready
        UNION ALL SELECT project, 'migration-safe', 'grade_f', grade, grade <> 'F' FROM ready
        UNION ALL SELECT project, 'migration-safe', 'qars_80', CAST(floor(q * 10 + 0.5) / 10 AS VARCHAR), floor(q * 10 + 0.5) / 10 < 80 FROM graded""",
    "compliance_rows": ctes("findings", "compliance", "deadlines") + _OPEN + f""", c AS (SELECT project, algorithm, count(*) AS n, min(pos) AS first_at FROM o GROUP BY project, algorithm),
        j AS (SELECT c.project, m.framework, c.algorithm, m.status, c.n, c.first_at, CASE WHEN d.deadline IS NULL THEN m.deadline_key ELSE d.deadline || ' (' || m.deadline_key || ')' END AS deadline,
            date_diff('day', DATE '{AS_OF}', CAST(d.deadline AS DATE)) AS days FROM c JOIN compliance m ON m.algorithm = c.algorithm LEFT JOIN deadlines d ON d.deadline_key = m.deadline_key)
        SELECT project, framework, algorithm, status, n, deadline, days, CASE WHEN days < 0 THEN 'OVERDUE' WHEN days < 365 THEN 'URGENT' WHEN days < 1095 THEN 'APPROACHING' WHEN days >= 1095 THEN 'DISTANT' END AS urgency,
          row_number() OVER (PARTITION BY project, framework ORDER BY CASE status WHEN 'NON-COMPLIANT' THEN 0 WHEN 'DEPRECATED' THEN 1 ELSE 2 END, first_at) AS place FROM j""",
    "framework_verdict": ctes("findings", "compliance") + _OPEN + """ SELECT project, framework, CASE min(CASE status WHEN 'NON-COMPLIANT' THEN 0 WHEN 'DEPRECATED' THEN 1 ELSE 2 END) WHEN 0 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS verdict
        FROM o JOIN compliance USING (algorithm) GROUP BY project, framework""",
    "deadline_countdown": ctes("findings", "compliance", "deadlines") + _OPEN + f""", j AS (SELECT DISTINCT o.project, o.algorithm, d.deadline_key AS category, d.deadline, date_diff('day', DATE '{AS_OF}', CAST(d.deadline AS DATE)) AS days
          FROM o JOIN compliance m ON m.algorithm = o.algorithm AND m.framework = 'CNSA 2.0' JOIN deadlines d ON d.deadline_key = m.deadline_key)
        SELECT *, CASE WHEN days < 0 THEN 'OVERDUE' WHEN days < 365 THEN 'URGENT' WHEN days < 1095 THEN 'APPROACHING' ELSE 'DISTANT' END AS urgency FROM j""",
    "risk_score_by_project": ctes("findings") + _OPEN + """, w AS (SELECT project, sum(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 1 ELSE 0 END) AS raw FROM o GROUP BY project)
        SELECT project, CASE WHEN raw = 0 THEN 0 ELSE least(100, CAST(trunc(20 * ln(CAST(raw + 1 AS DOUBLE))) AS BIGINT)) END AS risk FROM w""",
}
