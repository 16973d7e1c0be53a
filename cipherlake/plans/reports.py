"""Queries of report documents, fixes and contexts; SQL apart from operators.reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cipherlake import dims
from cipherlake.operators import reports
from cipherlake.plans import corpus
from cipherlake.plans.frames import ctes
from cipherlake.sources import documents
from cipherlake.sources.staging import fresh_path


def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.findings(spark, sf_dir).where("NOT suppressed")


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fixes(_open(spark, sf_dir)).select("path", "line", "ord", reports.unified_diff(F.col("path"), F.col("line"), F.col("snippet"), F.col("fixed")).alias("diff"))


def _fix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _open(spark, sf_dir)
    return rows.withColumn("fixed", reports.fixed_text(F.col("snippet"), F.col("ext"), F.col("algorithm"))).groupBy("project").agg(F.count("fixed").alias("deterministic"), F.count("*").alias("findings"))


def _patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.source_lines(spark, sf_dir)
    out = reports.patched_lines(lines.select("path", "line", "text"), reports.fixes(_open(spark, sf_dir)))
    return out.groupBy("text").agg(F.count("*").alias("n"))


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.context(corpus.source_lines(spark, sf_dir), _open(spark, sf_dir)).select("path", "line", "ord", F.md5("context").alias("context_md5"))


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's findings in the report's order: by severity, then as seen."""
    place = F.row_number().over(W.partitionBy("path").orderBy(reports.rank(F.col("severity")), "line", "ord"))
    return _open(spark, sf_dir).select("path", "line", "ord", place.cast("long").alias("place"))


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans as CSV lines of the eight columns, their algorithms joined by semicolons."""
    orders = corpus.table(spark, sf_dir, "orders")
    algorithms = F.array_join(F.sort_array(F.array_distinct(F.array(*(F.get(F.array(*map(F.lit, ["RSA", "MD5", "3DES", "ECDH, DH"])), ((F.col("o_orderkey") + i * F.col("o_custkey")) % 4).cast("int")) for i in range(3))))), ";")
    cols = [F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.concat(F.lit('pro"ject '), (F.col("o_custkey") % 50).cast("string")), F.col("o_orderkey") % 97, F.col("o_orderkey") % 40, F.floor("o_totalprice") % 101, F.col("o_orderstatus"), F.col("o_orderkey") % 11, algorithms]
    return orders.select(F.col("o_orderkey").alias("scan_id"), reports.csv_line(*cols).alias("line"))


def _written(document: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The lines of a document of the whole scan, written in sorted parts and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = fresh_path(spark, "document")
        documents.write_parts(document(_open(spark, sf_dir)), folder)
        return documents.read_parts(spark, folder)

    return run


def _sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of the scan's one SARIF document, parsed from what was written."""
    lines = _written(reports.scan_sarif)(spark, sf_dir).where("text LIKE '%\"ruleIndex\"%'")
    kind = "struct<ruleId: string, ruleIndex: bigint, level: string, message: struct<text: string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: bigint, snippet: struct<text: string>>>>>>"
    r = lines.select(F.from_json(F.regexp_replace("text", "^,", ""), kind).alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return r.select(place["artifactLocation"]["uri"].alias("path"), place["region"]["startLine"].alias("line"), F.col("r.ruleId").alias("rule_id"), F.col("r.ruleIndex").alias("rule_index"), F.col("r.level").alias("level"), place["region"]["snippet"]["text"].alias("snippet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "json_reports": lambda spark, sf_dir: reports.json_reports(_open(spark, sf_dir)),
    "sarif_documents": lambda spark, sf_dir: reports.sarif_documents(_open(spark, sf_dir)),
    "cbom_documents": lambda spark, sf_dir: reports.cbom_documents(_open(spark, sf_dir)),
    "text_reports": lambda spark, sf_dir: reports.text_reports(_open(spark, sf_dir)),
    "findings_by_severity": _ordered,
    "unified_diffs": _diffs,
    "fix_counts": _fix_counts,
    "patched_lines": _patched,
    "context_text": _context,
    "import_section": lambda spark, sf_dir: reports.import_section(corpus.source_lines(spark, sf_dir)),
    "csv_lines": _csv,
    "scan_sarif_results": _sarif_results,
    "scan_json_document": _written(reports.scan_json),
    "scan_text_report": _written(reports.scan_text),
    "strict_replacements": lambda spark, sf_dir: dims.frame(spark, "replacements").select("algorithm", reports.upgraded(F.col("replacement")).alias("replacement")),
}

_OPEN = ", o AS (SELECT * FROM findings WHERE NOT suppressed)"
_RANK = "CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END"
_LEVEL = "CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'none' END"
_FIX = "coalesce(" + ", ".join(f"CASE WHEN ext = {dims.literal(e)} AND list_contains(string_split(upper(algorithm), '/'), {dims.literal(a.upper())}) AND regexp_matches(snippet, {dims.literal('(?i)' + p)}) THEN nullif(regexp_replace(snippet, {dims.literal(p)}, {dims.literal(r)}, 'g'), snippet) END" for e, a, p, r in dims.FIXES) + ")"
_FIXED = ctes("findings") + _OPEN + f", x AS (SELECT *, {_FIX} AS fixed FROM o)"

SQL: dict[str, str] = {
    "json_reports": ctes("findings") + _OPEN + """ SELECT path, CAST(to_json({'path': path, 'summary': {'CRITICAL': count(*) FILTER (severity = 'CRITICAL'), 'HIGH': count(*) FILTER (severity = 'HIGH'), 'MEDIUM': count(*) FILTER (severity = 'MEDIUM'), 'LOW': count(*) FILTER (severity = 'LOW'), 'INFO': count(*) FILTER (severity = 'INFO')},
        'findings': list({'line': line, 'ord': ord, 'algorithm': algorithm, 'severity': severity, 'category': category, 'snippet': snippet} ORDER BY line, ord)}) AS VARCHAR) AS report FROM o GROUP BY path""",
    "sarif_documents": ctes("findings") + _OPEN + f""", r AS (SELECT path, algorithm, min(line * 100 + ord) AS first_at FROM o GROUP BY path, algorithm), i AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY first_at) - 1 AS idx FROM r),
        rules AS (SELECT path, list({{'id': 'PQC-' || algorithm, 'name': algorithm}} ORDER BY idx) AS rules FROM i GROUP BY path),
        results AS (SELECT o.path, list({{'ruleId': 'PQC-' || o.algorithm, 'ruleIndex': i.idx, 'level': {_LEVEL}, 'message': {{'text': o.algorithm || ' found'}}, 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': o.path}}, 'region': {{'startLine': line, 'snippet': {{'text': snippet}}}}}}}}]}} ORDER BY line, ord) AS results
          FROM o JOIN i ON i.path = o.path AND i.algorithm = o.algorithm GROUP BY o.path)
        SELECT path, CAST(to_json({{'version': '2.1.0', 'runs': [{{'tool': {{'driver': {{'name': 'cipherlake', 'rules': rules}}}}, 'results': results}}]}}) AS VARCHAR) AS document FROM rules JOIN results USING (path)""",
    "scan_sarif_results": ctes("findings") + _OPEN + f""", r AS (SELECT algorithm, row_number() OVER (ORDER BY path, line, ord) - 1 AS rule_index FROM (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY path, line, ord) AS k FROM o) WHERE k = 1)
        SELECT path, line, 'PQC-' || algorithm AS rule_id, rule_index, {_LEVEL} AS level, snippet FROM o JOIN r USING (algorithm)""",
    "scan_json_document": ctes("findings") + _OPEN + """, k AS (SELECT *, row_number() OVER (ORDER BY path, line, ord) AS place FROM o)
        SELECT CASE WHEN place = 1 THEN '' ELSE ',' END || CAST(to_json({'path': path, 'line': line, 'ord': ord, 'algorithm': algorithm, 'severity': severity, 'category': category, 'snippet': snippet}) AS VARCHAR) AS text FROM k
        UNION ALL SELECT '{"summary":' || CAST(to_json({'CRITICAL': count(*) FILTER (severity = 'CRITICAL'), 'HIGH': count(*) FILTER (severity = 'HIGH'), 'MEDIUM': count(*) FILTER (severity = 'MEDIUM'), 'LOW': count(*) FILTER (severity = 'LOW'), 'INFO': count(*) FILTER (severity = 'INFO')}) AS VARCHAR) || ',"findings":[' FROM o UNION ALL SELECT ']}'""",
    "scan_text_report": ctes("findings") + _OPEN + " SELECT '  ' || algorithm || ' at ' || path || ':' || line || ': ' || snippet AS text FROM o UNION ALL SELECT '[' || severity || '] ' || count(*) FROM o GROUP BY severity",
    "cbom_documents": ctes("findings", "cbom", "classical_bits", "replacements") + _OPEN + """, c AS (SELECT project, algorithm, count(*) AS n FROM o GROUP BY project, algorithm),
        d AS (SELECT c.*, b.primitive, b.family, k.bits, r.replacement FROM c LEFT JOIN cbom b USING (algorithm) LEFT JOIN classical_bits k USING (algorithm) LEFT JOIN replacements r USING (algorithm))
        SELECT project, CAST(to_json({'bomFormat': 'CycloneDX', 'specVersion': '1.7', 'serialNumber': 'urn:hash:' || md5(CAST(project AS VARCHAR) || ':' || CAST(sum(n) AS VARCHAR)), 'components': list({'name': algorithm, 'type': 'cryptographic-asset', 'ref': 'crypto-' || replace(replace(lower(algorithm), '/', '-'), ' ', '-'),
          'cryptoProperties': {'assetType': 'algorithm', 'algorithmProperties': {'primitive': coalesce(primitive, 'unknown'), 'parameterSetIdentifier': algorithm}, 'classicalSecurityLevel': coalesce(bits, 0), 'nistQuantumSecurityLevel': 0},
          'properties': [{'name': 'quantumSafe', 'value': 'false'}, {'name': 'algorithmFamily', 'value': coalesce(family, algorithm)}, {'name': 'findingCount', 'value': CAST(n AS VARCHAR)}, {'name': 'pqcReplacement', 'value': coalesce(replacement, 'review')}]} ORDER BY algorithm)}) AS VARCHAR) AS document FROM d GROUP BY project""",
    "text_reports": ctes("findings") + _OPEN + f""", p AS (SELECT path, {_RANK} AS r, '[' || severity || '] ' || count(*) || chr(10) || string_agg('  ' || algorithm || ' at line ' || line || ': ' || snippet, chr(10) ORDER BY line, ord) AS part FROM o GROUP BY path, severity)
        SELECT path, string_agg(part, chr(10) ORDER BY r) AS report FROM p GROUP BY path""",
    "findings_by_severity": ctes("findings") + _OPEN + f" SELECT path, line, ord, row_number() OVER (PARTITION BY path ORDER BY {_RANK}, line, ord) AS place FROM o",
    "unified_diffs": _FIXED + " SELECT path, line, ord, '--- a/' || string_split(path, '/')[-1] || chr(10) || '+++ b/' || string_split(path, '/')[-1] || chr(10) || '@@ -' || line || ',1 +' || line || ',1 @@' || chr(10) || '-' || snippet || chr(10) || '+' || fixed || chr(10) AS diff FROM x WHERE fixed IS NOT NULL",
    "fix_counts": _FIXED + " SELECT project, count(fixed) AS deterministic, count(*) AS findings FROM x GROUP BY project",
    "patched_lines": _FIXED + ", f AS (SELECT path, line, arg_min(fixed, ord) AS fixed FROM x WHERE fixed IS NOT NULL GROUP BY path, line) SELECT coalesce(f.fixed, l.text) AS text, count(*) AS n FROM lines l LEFT JOIN f ON f.path = l.path AND f.line = l.line GROUP BY 1",
    "context_text": ctes("findings") + _OPEN + r", c AS (SELECT o.path, o.line, o.ord, string_agg(CASE WHEN l.line = o.line THEN '>>> ' ELSE '    ' END || lpad(CAST(l.line AS VARCHAR), 4, ' ') || ' | ' || regexp_replace(l.text, '\s+$', ''), chr(10) ORDER BY l.line) AS context FROM o JOIN lines l ON l.path = o.path AND l.line >= o.line - 15 AND l.line <= o.line + 15 GROUP BY o.path, o.line, o.ord) SELECT path, line, ord, md5(context) AS context_md5 FROM c",
    "import_section": ctes("lines") + " SELECT path, line, trim(text) AS text FROM lines WHERE line <= 50 AND (starts_with(trim(text), 'import ') OR starts_with(trim(text), 'from ') OR starts_with(trim(text), 'require(') OR starts_with(trim(text), 'use ') OR starts_with(trim(text), 'using ') OR starts_with(trim(text), 'require ') OR starts_with(trim(text), '#include') OR starts_with(trim(text), 'package '))",
    "csv_lines": """WITH a AS (SELECT *, [['RSA', 'MD5', '3DES', 'ECDH, DH'][1 + (o_orderkey + i * o_custkey) % 4] for i in range(0, 3)] AS l FROM orders), j AS (SELECT *, array_to_string(list_sort(list_distinct(l)), ';') AS algorithms FROM a)
        SELECT o_orderkey AS scan_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || ',"pro""ject ' || (o_custkey % 50) || '",' || (o_orderkey % 97) || ',' || (o_orderkey % 40) || ',' || (CAST(floor(o_totalprice) AS BIGINT) % 101) || ',' || o_orderstatus || ',' || (o_orderkey % 11) || ',' || CASE WHEN contains(algorithms, ',') THEN '"' || algorithms || '"' ELSE algorithms END AS line FROM j""",
    "strict_replacements": ctes("replacements") + " SELECT algorithm, replace(replace(replacement, 'ML-KEM-768', 'ML-KEM-1024'), 'ML-DSA-65', 'ML-DSA-87') AS replacement FROM replacements",
}
