"""The library's queries: base frames built with the DataFrame API, final steps as SQL that both Spark and the oracle run."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake import dims
from cipherlake.functions import bits, lex
from cipherlake.operators.graph import shortest_levels
from cipherlake.operators.limiter import accepts
from cipherlake.operators.match import scan_rules
from cipherlake.plans import certificates, code, corpus, dependencies, fixes, kernels, merged, paths, protocols, reports, scans, scoring, streams, structure, texts
from cipherlake.plans.frames import ORACLE_FRAMES
from cipherlake.streaming import continuous

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "conversations", "pages", "labels"]

def _frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in dims.TABLES:
        return dims.frame(spark, name)
    if name in DRIVER_TABLES:
        return corpus.table(spark, sf_dir, name)
    if name == "lines":
        return corpus.source_lines(spark, sf_dir)
    if name == "rule_findings":
        return scan_rules(corpus.source_lines(spark, sf_dir)).select("project", "file", "line", "language", "rule_id", "severity", "category", "algorithm")
    return corpus.findings(spark, sf_dir)


OPEN = "open_ AS (SELECT * FROM $findings WHERE NOT suppressed)"
#: History rows derived from orders, and dependencies from part.
HISTORY = "history AS (SELECT o_orderkey AS scan_id, o_custkey % 50 AS project, o_orderdate AS ts, o_orderpriority AS scanner, CAST(floor(o_totalprice) AS BIGINT) % 101 AS risk, o_orderkey % 40 AS total, o_orderkey % 7 AS critical FROM $orders)"
DEPS = "deps AS (SELECT p_partkey, p_brand AS manifest, CASE WHEN p_partkey % 2 = 0 THEN 'pip' ELSE 'npm' END AS ecosystem, CASE p_partkey % 11 WHEN 0 THEN 'PyCryptodome' WHEN 1 THEN 'node-rsa' WHEN 2 THEN 'requests' WHEN 3 THEN 'my-elliptic' WHEN 4 THEN 'rsa' WHEN 5 THEN 'jose' WHEN 6 THEN 'google.auth' WHEN 7 THEN 'left-pad' WHEN 8 THEN 'ecdsa' WHEN 9 THEN 'node-forge' ELSE 'numpy' END AS package, CAST(p_size AS VARCHAR) AS version, p_partkey % 3 = 0 AS is_transitive FROM $part)"
DEPS_SPARK = DEPS.replace("AS VARCHAR", "AS STRING")
DEP_HITS = "hits AS (SELECT d.*, k.package AS known, k.risk FROM deps d JOIN $packages k ON k.ecosystem = d.ecosystem AND (replace(replace(lower(d.package), '-', '_'), '.', '_') = k.package OR replace(replace(lower(d.package), '-', '_'), '.', '_') LIKE '%\\_' || k.package ESCAPE '\\'))".replace("LIKE '%\\_' || k.package ESCAPE '\\'", "LIKE concat('%~_', k.package) ESCAPE '~'")
EDGES = "edges AS (SELECT DISTINCT concat('n', CAST(l_linenumber AS {text}), '_', CAST(l_suppkey % 10 AS {text})) AS caller, concat('n', CAST(l_linenumber + 1 AS {text}), '_', CAST(l_partkey % 10 AS {text})) AS callee FROM $lineitem)"
FP = "concat_ws(':', path, CAST(line AS {text}), algorithm, category)"
#: The baseline: findings of flag R as they are, those of flag A a thousand lines below (fixed since), none of flag N (new).
OLD = FP.replace("line AS", "line + CASE WHEN flag = 'A' THEN 1000 ELSE 0 END AS")
BASE = OPEN + f", cur AS (SELECT {FP} AS fp, max_by(snippet, ord) AS snippet FROM open_ GROUP BY {FP}), base AS (SELECT {OLD} AS fp, project FROM open_ WHERE flag <> 'N')"
BITS = "bits AS (SELECT event_id AS i, (event_id * 7 + 3) % 11 % 2 AS alice_bit, (event_id * 13 + 5) % 7 % 2 AS alice_basis, (event_id * 17 + 1) % 5 % 2 AS bob_basis, user_id FROM $events), sifted AS (SELECT i, alice_bit, CASE WHEN (i * 31) % 29 = 0 THEN 1 - alice_bit ELSE alice_bit END AS bob_bit, row_number() OVER (PARTITION BY i % 50 ORDER BY i) AS k, count(*) OVER (PARTITION BY i % 50) AS n, i % 50 AS run FROM bits WHERE alice_basis = bob_basis)"

#: name -> SQL: common table expressions, then ";;", then the select. $name is a base frame, {text} the engine's string type.
SHARED: dict[str, str] = {
    # scan and predicates
    "scan_findings": OPEN + ";; SELECT project, language, algorithm, severity, count(*) AS n FROM open_ GROUP BY project, language, algorithm, severity",
    "severity_summary": OPEN + ";; SELECT p.project, s.severity, count(f.file) AS n FROM (SELECT DISTINCT project FROM open_) p CROSS JOIN (SELECT column_0 AS severity FROM severity_names) s LEFT JOIN open_ f ON f.project = p.project AND f.severity = s.severity GROUP BY p.project, s.severity",
    "risk_score_by_file": OPEN + ";; SELECT f.file, least(100, CAST(floor(20 * ln(CAST(sum(s.weight) AS DOUBLE) + 1)) AS BIGINT)) AS risk FROM open_ f JOIN $severities s ON s.severity = f.severity GROUP BY f.file",
    "inline_suppression": ";; SELECT algorithm, count(*) AS hits, CAST(sum(CASE WHEN suppressed THEN 1 ELSE 0 END) AS BIGINT) AS suppressed_hits FROM $findings GROUP BY algorithm",
    "severity_filter": OPEN + ";; SELECT f.file, f.line, f.algorithm, f.severity FROM open_ f JOIN $severities s ON s.severity = f.severity WHERE s.rank <= 1",
    "ignore_globs": OPEN + ";; SELECT project, count(*) AS n FROM open_ WHERE NOT (path LIKE '%tests/%' OR path LIKE '%.conf') GROUP BY project",
    "rule_scan": ";; SELECT rule_id, language, severity, count(*) AS n FROM $rule_findings GROUP BY rule_id, language, severity",
    "merge_dedupe_anti": OPEN + ", other AS (SELECT DISTINCT file, line, algorithm FROM $rule_findings);; SELECT o.file, o.line, o.algorithm FROM other o LEFT JOIN (SELECT DISTINCT file, line, algorithm FROM open_) f ON f.file = o.file AND f.line = o.line AND f.algorithm = o.algorithm WHERE f.file IS NULL",
    "finding_ids": OPEN + ";; SELECT project, file, line, ord, row_number() OVER (PARTITION BY project ORDER BY file, line, ord) AS finding_no FROM open_",
    "snippet_projection": OPEN + ";; SELECT DISTINCT language, algorithm, snippet FROM open_",
    # baseline diff
    "baseline_new": BASE + ";; SELECT c.fp, c.snippet FROM cur c LEFT JOIN (SELECT DISTINCT fp FROM base) b ON b.fp = c.fp WHERE b.fp IS NULL",
    "baseline_existing": BASE + ";; SELECT c.fp, c.snippet FROM cur c JOIN (SELECT DISTINCT fp FROM base) b ON b.fp = c.fp",
    "baseline_fixed": BASE + ";; SELECT b.fp, b.project FROM base b LEFT JOIN cur c ON c.fp = b.fp WHERE c.fp IS NULL",
    "mosca": ";; SELECT p_partkey, p_size AS shelf, p_partkey % 8 AS migration, p_partkey % 20 AS threat, p_size + p_partkey % 8 > p_partkey % 20 AS urgent, p_partkey % 20 - (p_size + p_partkey % 8) AS margin FROM $part",
    # migration
    "migration_estimate": OPEN + ", c AS (SELECT project, algorithm, count(*) AS n FROM open_ GROUP BY project, algorithm);; SELECT c.project, c.algorithm, c.n, coalesce(e.kind, 'API_CHANGE') AS kind, coalesce(e.hours, CAST(3.0 AS DOUBLE)) * c.n AS hours FROM c LEFT JOIN $effort e ON e.algorithm = c.algorithm",
    "migration_totals": OPEN + ", h AS (SELECT f.project, sum(coalesce(e.hours, CAST(3.0 AS DOUBLE))) AS hours FROM open_ f LEFT JOIN $effort e ON e.algorithm = f.algorithm GROUP BY f.project);; SELECT project, hours, floor(hours * 3 + 0.5) / 10 AS testing, floor(hours * 2 + 0.5) / 10 AS review, floor(hours + 0.5) / 10 AS deployment, CAST(floor(hours * CAST(1.6 AS DOUBLE) * 150 + 0.5) AS BIGINT) AS cost FROM h",
    "estimates_by_hours": OPEN + ", h AS (SELECT f.algorithm, sum(coalesce(e.hours, CAST(3.0 AS DOUBLE))) AS hours FROM open_ f LEFT JOIN $effort e ON e.algorithm = f.algorithm GROUP BY f.algorithm);; SELECT algorithm, hours, row_number() OVER (ORDER BY hours DESC, algorithm) AS place FROM h",
    # dependencies
    "dep_findings": "{deps}, " + DEP_HITS + ";; SELECT p_partkey, manifest, package, version, known, risk, is_transitive FROM hits",
    "dep_risk_counts": "{deps}, " + DEP_HITS + ";; SELECT ecosystem, risk, count(*) AS n, count(DISTINCT manifest) AS manifests FROM hits GROUP BY ecosystem, risk",
    "sbom_status": "{deps}, hits AS (SELECT d.manifest, d.package, k.risk FROM deps d LEFT JOIN $packages k ON k.ecosystem = d.ecosystem AND replace(replace(lower(d.package), '-', '_'), '.', '_') = k.package);; SELECT manifest, CASE WHEN max(CASE WHEN risk = 'CRITICAL' THEN 1 ELSE 0 END) = 1 THEN 'vulnerable' WHEN max(CASE WHEN risk = 'HIGH' THEN 1 ELSE 0 END) = 1 THEN 'broken' WHEN max(CASE WHEN risk = 'MEDIUM' THEN 1 ELSE 0 END) = 1 THEN 'weakened' ELSE 'safe' END AS status, count(*) AS components FROM hits GROUP BY manifest",
    "lock_dedupe": ";; SELECT p_brand AS module, CAST(p_size AS {text}) AS version, min(p_partkey) AS line FROM $part GROUP BY p_brand, CAST(p_size AS {text})",
    "reachability_levels": OPEN + ", used AS (SELECT algorithm, count(DISTINCT CASE WHEN severity = 'CRITICAL' THEN file * 1000000 + line END) AS calls, count(DISTINCT file * 1000000 + line) AS imports FROM open_ GROUP BY algorithm);; SELECT algorithm, CASE WHEN calls > 0 THEN 'CONFIRMED' WHEN imports > 0 THEN 'REACHABLE' ELSE 'AVAILABLE' END AS level, floor(100 * CASE WHEN calls > 0 THEN least(CAST(1.0 AS DOUBLE), CAST(0.7 AS DOUBLE) + CAST(0.05 AS DOUBLE) * calls) WHEN imports > 0 THEN least(CAST(0.7 AS DOUBLE), CAST(0.3 AS DOUBLE) + CAST(0.1 AS DOUBLE) * imports) ELSE CAST(0.1 AS DOUBLE) END + 0.5) / 100 AS confidence FROM used",
    "backward_slice_asof": OPEN + ", marks AS (SELECT file, line FROM $lines WHERE text LIKE '%=%'), near AS (SELECT f.file, f.line, f.ord, max(m.line) AS assigned FROM open_ f JOIN marks m ON m.file = f.file AND m.line BETWEEN f.line - 48 AND f.line - 1 GROUP BY f.file, f.line, f.ord);; SELECT file, line, ord, assigned FROM near",
    "context_window": OPEN + ";; SELECT f.file, f.line, f.ord, count(*) AS lines_around, min(k.line) AS first_line FROM open_ f JOIN $lines k ON k.file = f.file AND k.line BETWEEN f.line - 15 AND f.line + 15 GROUP BY f.file, f.line, f.ord",
    # history
    "history_topn": HISTORY + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, scan_id DESC) AS k FROM history);; SELECT project, scan_id, risk, k FROM ranked WHERE k <= 20",
    "history_retention": HISTORY + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, scan_id DESC) AS k FROM history);; SELECT project, count(*) AS dropped FROM ranked WHERE k > 10 GROUP BY project",
    "projects_rollup": HISTORY + ";; SELECT project, count(*) AS scans, max(risk) AS worst, min(risk) AS best, max_by(risk, CAST(scan_id AS BIGINT)) AS newest FROM history GROUP BY project",
    "scanner_rollup": HISTORY + ";; SELECT scanner, count(*) AS scans, CAST(floor(avg(risk)) AS BIGINT) AS avg_risk, CAST(sum(total) AS BIGINT) AS findings FROM history GROUP BY scanner",
    "latest_delta": HISTORY + ", d AS (SELECT project, scan_id, risk - lag(risk) OVER (PARTITION BY project ORDER BY ts, scan_id) AS risk_delta, total - lag(total) OVER (PARTITION BY project ORDER BY ts, scan_id) AS total_delta, row_number() OVER (PARTITION BY project ORDER BY ts DESC, scan_id DESC) AS k FROM history);; SELECT project, scan_id, risk_delta, total_delta FROM d WHERE k = 1",
    "trend_direction": HISTORY + ", r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, scan_id DESC) AS k FROM history), e AS (SELECT project, count(*) AS n, max(CASE WHEN k = 1 THEN risk END) AS last_risk, max_by(risk, k) AS first_risk FROM r WHERE k <= 10 GROUP BY project);; SELECT project, CASE WHEN n < 2 THEN 'unknown' WHEN last_risk - first_risk < -5 THEN 'improving' WHEN last_risk - first_risk > 5 THEN 'declining' ELSE 'stable' END AS trend FROM e",
    "severity_running_total": HISTORY + ";; SELECT project, scan_id, CAST(sum(critical) OVER (PARTITION BY project ORDER BY ts, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM history",
    "donut_share": OPEN + ", c AS (SELECT severity, count(*) AS n FROM open_ GROUP BY severity);; SELECT severity, n, CAST(sum(n) OVER (ORDER BY n DESC, severity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto, CAST(sum(n) OVER () AS BIGINT) AS total FROM c",
    # reports
    "sarif_rules": OPEN + ", f AS (SELECT algorithm, min(file * 1000000 + line * 100 + ord) AS first_at, count(*) AS n FROM open_ GROUP BY algorithm);; SELECT algorithm, n, dense_rank() OVER (ORDER BY first_at) - 1 AS rule_index FROM f",
    "sarif_results": OPEN + ";; SELECT path, line, algorithm, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'none' END AS level FROM open_",
    "cbom_components": OPEN + ", c AS (SELECT algorithm, count(*) AS findings, count(DISTINCT file) AS files FROM open_ GROUP BY algorithm);; SELECT c.algorithm, c.findings, c.files, coalesce(r.replacement, 'review') AS replacement FROM c LEFT JOIN $replacements r ON r.algorithm = c.algorithm",
    "top10_per_severity": OPEN + ", r AS (SELECT severity, file, line, ord, row_number() OVER (PARTITION BY severity ORDER BY file, line, ord) AS k FROM open_);; SELECT severity, file, line, ord, k FROM r WHERE k <= 10",
    "triage_top50": OPEN + ", r AS (SELECT f.file, f.line, f.ord, s.rank AS severity_rank, row_number() OVER (PARTITION BY f.project ORDER BY s.rank, f.file, f.line, f.ord) AS k, f.project FROM open_ f JOIN $severities s ON s.severity = f.severity);; SELECT project, file, line, ord, severity_rank, k FROM r WHERE k <= 50",
    "csv_export": HISTORY + ";; SELECT project, scan_id, risk, total, critical, scanner FROM history WHERE risk >= 50",
    # text and simulation
    "bb84_sift": BITS + ";; SELECT run, count(*) AS kept FROM sifted GROUP BY run",
    "bb84_qber": BITS + ", q AS (SELECT run, CAST(sum(CASE WHEN alice_bit <> bob_bit THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS qber FROM sifted WHERE k <= greatest(1, CAST(floor(n / 4) AS BIGINT)) GROUP BY run);; SELECT run, floor(qber * 1000000 + 0.5) / 1000000 AS qber FROM q",
    "bb84_parity": BITS + ", b AS (SELECT run, CAST(floor((k - 1) / 4) AS BIGINT) AS block, sum(alice_bit) % 2 AS pa, sum(bob_bit) % 2 AS pb, count(*) AS n FROM sifted GROUP BY run, CAST(floor((k - 1) / 4) AS BIGINT));; SELECT run, count(*) AS blocks, CAST(sum(CASE WHEN pa = pb AND n = 4 THEN 3 ELSE 0 END) AS BIGINT) AS kept_bits FROM b GROUP BY run",
    "e91_chsh": "t AS (SELECT event_id % 2 AS a, CAST(floor(event_id / 2) AS BIGINT) % 2 AS b, CASE WHEN event_id % 5 < 4 THEN 1 ELSE -1 END AS x, user_id FROM $events), m AS (SELECT coalesce(avg(CASE WHEN a = 0 AND b = 0 THEN x END), 0) AS e00, coalesce(avg(CASE WHEN a = 0 AND b = 1 THEN x END), 0) AS e01, coalesce(avg(CASE WHEN a = 1 AND b = 0 THEN x END), 0) AS e10, coalesce(avg(CASE WHEN a = 1 AND b = 1 THEN x END), 0) AS e11 FROM t);; SELECT floor(abs(e00 - e01 + e10 + e11) * 1000000 + 0.5) / 1000000 AS chsh FROM m",
    "outcome_histogram": "c AS (SELECT user_id % 16 AS outcome, count(*) AS n FROM $events GROUP BY user_id % 16), r AS (SELECT outcome, n, row_number() OVER (ORDER BY n DESC, outcome) AS k FROM c);; SELECT outcome, n, k FROM r WHERE k <= 5",
    "hash_digests": ";; SELECT doc_id, {sha256} AS sha256_hex, {sha1} AS sha1_hex, md5(text) AS md5_hex FROM $documents",
    "loc_statistics": ";; SELECT language, count(*) AS lines, CAST(sum(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS code_lines, count(DISTINCT file) AS files FROM $lines WHERE path NOT LIKE '%tests/%' GROUP BY language",
    "fp_natural_language": ";; SELECT lang, count(*) AS docs, CAST(sum(CASE WHEN {des} THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM $documents GROUP BY lang",
    "precision_recall": ", p AS (SELECT file, line, max(CASE WHEN NOT suppressed THEN 1 ELSE 0 END) AS found FROM $findings GROUP BY file, line), t AS (SELECT k.file, k.line, CASE WHEN k.text LIKE '%rsa%' OR k.text LIKE '%RSA%' THEN 1 ELSE 0 END AS expected, coalesce(p.found, 0) AS found FROM $lines k LEFT JOIN p ON p.file = k.file AND p.line = k.line), s AS (SELECT CAST(sum(expected * found) AS BIGINT) AS tp, CAST(sum((1 - expected) * found) AS BIGINT) AS fp, CAST(sum(expected * (1 - found)) AS BIGINT) AS fn FROM t);; SELECT tp, fp, fn, floor(10000 * CAST(tp AS DOUBLE) / (tp + fp) + 0.5) / 10000 AS precision_, floor(10000 * CAST(tp AS DOUBLE) / (tp + fn) + 0.5) / 10000 AS recall FROM s".lstrip(", "),
}

_SPARK = {"text": "STRING", "deps": DEPS_SPARK, "sha256": "sha2(text, 256)", "sha1": "sha1(text)", "des": r"text RLIKE '(^|[ .,;:])[Dd][Ee][Ss]([ .,;:]|$)'"}
_DUCK = {"text": "VARCHAR", "deps": DEPS, "sha256": "sha256(text)", "sha1": "sha1(text)", "des": r"regexp_matches(text, '(^|[ .,;:])[Dd][Ee][Ss]([ .,;:]|$)')"}


def _fill(sql: str, words: dict[str, str]) -> str:
    for k in ("deps", *words):
        sql = sql.replace("{" + k + "}", words[k])
    return sql.replace("{text}", words["text"])


_NAMES = "severity_names AS (SELECT * FROM (VALUES " + ", ".join(f"('{s[0]}')" for s in dims.SEVERITIES) + ") AS v(column_0))"


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    head, _, select = _fill(SHARED[name], _SPARK).partition(";;")
    if "severity_names" in select:
        head += ", " + _NAMES
    sql = ("WITH " + head + " " if head.strip() else "") + select
    used = sorted(set(re.findall(r"\$(\w+)", sql)), key=len, reverse=True)
    # Braces of patterns are not places for frames.
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in used:
        sql = sql.replace(f"${n}", "{" + n + "}")
    return spark.sql(sql, **{n: _frame(spark, sf_dir, n) for n in used})


def _oracle(name: str) -> str:
    head, _, select = _fill(SHARED[name], _DUCK).partition(";;")
    ctes, done = [], set()

    def need(n: str) -> None:
        if n in done or n in DRIVER_TABLES:
            return
        done.add(n)
        for m in ORACLE_FRAMES.get(n, ([], ""))[0]:
            need(m)
        ctes.append(ORACLE_FRAMES[n][1] if n in ORACLE_FRAMES else dims.values_sql(n))

    for n in sorted(set(re.findall(r"\$(\w+)", head + select))):
        need(n)
    if "severity_names" in select:
        ctes.append(_NAMES)
    if head.strip():
        ctes.append(head)
    return re.sub(r"\$(\w+)", r"\1", ("WITH " + ", ".join(ctes) + " " if ctes else "") + select)


# Queries with DataFrame steps of their own.
def _strip_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.source_lines(spark, sf_dir).select("language", lex.blank_strings(F.col("text")).alias("blanked")).groupBy("language", "blanked").agg(F.count("*").alias("n"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("WITH " + EDGES.replace("{text}", "STRING").replace("$lineitem", "{lineitem}") + " SELECT caller, callee FROM edges", lineitem=corpus.table(spark, sf_dir, "lineitem"))


def _starts(edges: DataFrame) -> DataFrame:
    """Entry points: callers that nothing calls."""
    return edges.select(F.col("caller").alias("node")).distinct().join(edges.select(F.col("callee").alias("node")).distinct(), "node", "left_anti")


def _entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _starts(_edges(spark, sf_dir))


def _bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return shortest_levels(edges, _starts(edges), 10)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    sinks = edges.select(F.col("callee").alias("node")).distinct().join(edges.select(F.col("caller").alias("node")).distinct(), "node", "left_anti")
    return sinks.join(shortest_levels(edges, _starts(edges).where(F.col("node").endswith("0")), 2).select("node"), "node", "left_anti")


def _graph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    nodes = edges.select(F.col("caller").alias("node")).union(edges.select("callee")).distinct()
    return edges.agg(F.count("*").alias("edges")).join(nodes.agg(F.count("*").alias("nodes")), F.lit(True))


def _fix_tier1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First substitution of the line's extension and algorithm that changes the snippet."""
    rows = corpus.findings(spark, sf_dir).where("NOT suppressed")
    fixed = F.coalesce(*(F.when((F.col("ext") == e) & F.array_contains(F.split("algorithm", "/"), a) & F.col("snippet").rlike("(?i)" + p), F.nullif(F.regexp_replace("snippet", p, r.replace("$", "\\$")), F.col("snippet"))) for e, a, p, r in dims.FIXES))
    return rows.select("file", "line", "ord", "snippet", fixed.alias("fixed")).where("fixed IS NOT NULL")


def _limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    return accepts(calls, 2, 86_400).groupBy("key").agg(F.count("*").alias("calls"), F.sum(F.col("accepted").cast("long")).alias("accepted"))


def _tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events")
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events")
    return e.groupBy(F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def _stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuous.run_once(continuous.tumbling_counts(continuous.event_stream(spark, sf_dir)))


_EDGES_SQL = "WITH RECURSIVE " + EDGES.replace("{text}", "VARCHAR").replace("$", "")
_START_SQL = "starts AS (SELECT DISTINCT caller AS node FROM edges WHERE caller NOT IN (SELECT callee FROM edges))"
_REACH_SQL = "reach AS (SELECT node, CAST(0 AS BIGINT) AS depth FROM {starts} UNION SELECT e.callee, r.depth + 1 FROM reach r JOIN edges e ON e.caller = r.node WHERE r.depth < 10)"


def _own_sql() -> dict[str, str]:
    lines = ", ".join([dims.values_sql("languages"), dims.values_sql("templates"), ORACLE_FRAMES["lines"][1]])
    fix = "coalesce(" + ", ".join(f"CASE WHEN ext = {dims.literal(e)} AND list_contains(string_split(algorithm, '/'), {dims.literal(a)}) AND regexp_matches(snippet, {dims.literal('(?i)' + p)}) THEN nullif(regexp_replace(snippet, {dims.literal(p)}, {dims.literal(r)}, 'g'), snippet) END" for e, a, p, r in dims.FIXES) + ")"
    return {
        "strip_strings": f"WITH {lines} SELECT language, regexp_replace(regexp_replace(text, '\"[^\"\\\\\\n]*(?:\\\\.[^\"\\\\\\n]*)*\"', '\"\"', 'g'), '''[^''\\\\\\n]*(?:\\\\.[^''\\\\\\n]*)*''', '''''', 'g') AS blanked, count(*) AS n FROM lines GROUP BY 1, 2",
        "callgraph_entry_points": f"{_EDGES_SQL}, {_START_SQL} SELECT node FROM starts",
        "callgraph_bfs": f"{_EDGES_SQL}, {_START_SQL}, {_REACH_SQL.replace('{starts}', 'starts')} SELECT node, min(depth) AS depth FROM reach GROUP BY node",
        "callgraph_orphans": f"{_EDGES_SQL}, {_START_SQL}, chosen AS (SELECT node FROM starts WHERE node LIKE '%0'), {_REACH_SQL.replace('{starts}', 'chosen').replace('r.depth < 10', 'r.depth < 2')} SELECT DISTINCT callee AS node FROM edges WHERE callee NOT IN (SELECT caller FROM edges) AND callee NOT IN (SELECT node FROM reach)",
        "callgraph_totals": f"{_EDGES_SQL} SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM (SELECT caller FROM edges UNION SELECT callee FROM edges)) AS nodes",
        "fix_tier1": f"WITH {lines}, {ORACLE_FRAMES['findings'][1]}, f AS (SELECT file, line, ord, snippet, {fix} AS fixed FROM findings WHERE NOT suppressed) SELECT file, line, ord, snippet, fixed FROM f WHERE fixed IS NOT NULL",
        "rate_limit_accepts": """WITH RECURSIVE e AS (SELECT user_id AS key, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts), event_id) AS k FROM events),
            r AS (SELECT key, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS kept, false AS ok FROM (SELECT DISTINCT key FROM e) d
              UNION ALL SELECT r.key, e.k, CASE WHEN len(list_filter(r.kept, lambda x: x >= e.t - 86400)) < 2 THEN list_append(list_filter(r.kept, lambda x: x >= e.t - 86400), e.t) ELSE list_filter(r.kept, lambda x: x >= e.t - 86400) END,
                len(list_filter(r.kept, lambda x: x >= e.t - 86400)) < 2 FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
            SELECT key, count(*) AS calls, count(*) FILTER (ok) AS accepted FROM r WHERE k > 0 GROUP BY key""",
        "tumbling_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "stream_tumbling_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "session_activity": "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new, event_id FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
    }


OWN = {
    "strip_strings": _strip_strings,
    "callgraph_entry_points": _entry_points,
    "callgraph_bfs": _bfs,
    "callgraph_orphans": _orphans,
    "callgraph_totals": _graph_totals,
    "fix_tier1": _fix_tier1,
    "rate_limit_accepts": _limiter,
    "tumbling_events": _tumbling,
    "session_activity": _sessions,
    "stream_tumbling_events": _stream_tumbling,
}


#: Modules with queries and SQL of their own.
MODULES = [certificates, dependencies, fixes, scoring, code, structure, merged, texts, reports, scans, protocols, streams, paths, kernels]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {n: partial(_run, n) for n in SHARED} | OWN
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {n: _oracle(n) for n in SHARED} | _own_sql()
    for m in MODULES:
        out |= m.SQL
    out["stream_rate_limit"] = out["rate_limit_accepts"]  # micro-batches give the rows of the batch
    return out
