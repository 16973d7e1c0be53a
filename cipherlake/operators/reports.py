"""Report documents of findings as rows of text: JSON, SARIF, bills of materials, text, diffs, CSV.

A document covers one file, whose findings are few; what a whole project has is counted, or written as
one line an occurrence, so no document grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cipherlake import dims
from cipherlake.operators.once import once

SEVERITIES = [s[0] for s in dims.SEVERITIES]


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def level(severity: Column) -> Column:
    """SARIF's level of a severity."""
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").when(severity == "MEDIUM", "warning").when(severity == "LOW", "note").when(severity == "INFO", "none").otherwise("warning")


def _sorted(rows: Column) -> Column:
    return F.array_sort(F.collect_list(rows))


def json_reports(findings: DataFrame) -> DataFrame:
    """(path, report): a file's findings in order and their number by severity."""
    one = F.struct("line", "ord", "algorithm", "severity", "category", "snippet")
    counts = F.struct(*(F.sum((F.col("severity") == s).cast("long")).alias(s) for s in SEVERITIES))
    rows = findings.groupBy("path").agg(_sorted(one).alias("findings"), counts.alias("summary"))
    return rows.select("path", F.to_json(F.struct("path", "summary", "findings")).alias("report"))


def sarif_documents(findings: DataFrame) -> DataFrame:
    """(path, document): SARIF 2.1.0 with a rule an algorithm, in the order in which they are first seen, and results that name their rule's index."""
    keyed = findings.groupBy("path").agg(_sorted(F.struct("line", "ord", "algorithm", "severity", "snippet")).alias("f"))
    keyed = keyed.withColumn("rules", F.array_distinct(F.transform("f", lambda x: x["algorithm"])))
    results = F.transform(
        "f",
        lambda x: F.struct(
            F.concat(F.lit("PQC-"), x["algorithm"]).alias("ruleId"), (F.array_position("rules", x["algorithm"]) - 1).alias("ruleIndex"), level(x["severity"]).alias("level"),
            F.struct(F.concat(x["algorithm"], F.lit(" found")).alias("text")).alias("message"),
            F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(x["line"].alias("startLine"), F.struct(x["snippet"].alias("text")).alias("snippet")).alias("region")).alias("physicalLocation"))).alias("locations"),
        ),
    )
    rules = F.transform("rules", lambda a: F.struct(F.concat(F.lit("PQC-"), a).alias("id"), a.alias("name")))
    run = F.struct(F.struct(F.struct(F.lit("cipherlake").alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), results.alias("results"))
    return keyed.select("path", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def cbom_documents(findings: DataFrame) -> DataFrame:
    """(project, document): CycloneDX 1.7 with a component an algorithm; unknown algorithms have primitive unknown and their own family.

    The serial number is a hash of the project and its counts, so reruns agree.
    """
    spark = findings.sparkSession
    per = findings.groupBy("project", "algorithm").agg(F.count("*").alias("n"))
    for name in ("cbom", "classical_bits", "replacements"):
        per = per.join(F.broadcast(dims.frame(spark, name)), "algorithm", "left")
    properties = F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in (("quantumSafe", F.lit("false")), ("algorithmFamily", F.coalesce("family", "algorithm")), ("findingCount", F.col("n").cast("string")), ("pqcReplacement", F.coalesce("replacement", F.lit("review"))))))
    crypto = F.struct(F.lit("algorithm").alias("assetType"), F.struct(F.coalesce("primitive", F.lit("unknown")).alias("primitive"), F.col("algorithm").alias("parameterSetIdentifier")).alias("algorithmProperties"), F.coalesce("bits", F.lit(0)).alias("classicalSecurityLevel"), F.lit(0).alias("nistQuantumSecurityLevel"))
    component = F.struct(F.col("algorithm").alias("name"), F.lit("cryptographic-asset").alias("type"), F.concat(F.lit("crypto-"), F.translate(F.lower("algorithm"), "/ ", "--")).alias("ref"), crypto.alias("cryptoProperties"), properties.alias("properties"))
    rows = per.withColumn("c", component).groupBy("project").agg(_sorted(F.col("c")).alias("components"), F.sum("n").alias("n"))
    serial = F.concat(F.lit("urn:hash:"), F.md5(F.concat_ws(":", F.col("project").cast("string"), F.col("n").cast("string"))))
    return rows.select("project", F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.7").alias("specVersion"), serial.alias("serialNumber"), "components")).alias("document"))


def text_reports(findings: DataFrame) -> DataFrame:
    """(path, report): a file's findings under headings by severity, worst first."""
    rows = findings.withColumn("r", rank(F.col("severity"))).groupBy("path", "r", "severity").agg(_sorted(F.struct("line", "ord", "algorithm", "snippet")).alias("f"))
    body = F.array_join(F.transform("f", lambda x: F.concat(F.lit("  "), x["algorithm"], F.lit(" at line "), x["line"].cast("string"), F.lit(": "), x["snippet"])), "\n")
    part = rows.withColumn("part", F.concat(F.lit("["), "severity", F.lit("] "), F.size("f").cast("string"), F.lit("\n"), body))
    return part.groupBy("path").agg(F.array_join(F.transform(_sorted(F.struct("r", "part")), lambda x: x["part"]), "\n").alias("report"))


def fixed_text(snippet: Column, ext: Column, algorithm: Column) -> Column:
    """The snippet after the first substitution for its extension and algorithm that is found, whatever the case, and changes it; else null."""
    ext = F.when(ext == ".cfg", ".conf").otherwise(ext)
    found = [F.when((ext == e) & F.array_contains(F.transform(F.split(F.upper(algorithm), "/"), lambda x: F.trim(x)), a.upper()) & snippet.rlike("(?i)" + p), F.nullif(F.regexp_replace(snippet, p, r.replace("$", "\\$")), snippet)) for e, a, p, r in dims.FIXES]
    return F.coalesce(*found)


def fixes(findings: DataFrame) -> DataFrame:
    """(path, line, ord, algorithm, snippet, fixed) of the findings that a substitution mends; equal snippets are mended once."""
    mended = lambda kinds: kinds.withColumn("fixed", fixed_text(F.col("snippet"), F.col("ext"), F.col("algorithm"))).where("fixed IS NOT NULL")
    return once(findings, ["ext", "algorithm", "snippet"], mended, "mended").select("path", "line", "ord", "algorithm", "snippet", "fixed")


def unified_diff(path: Column, line: Column, before: Column, after: Column) -> Column:
    """A diff of one line of a file, headed by the file's own name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -"), line.cast("string"), F.lit(",1 +"), line.cast("string"), F.lit(",1 @@\n-"), before, F.lit("\n+"), after, F.lit("\n"))


def patched_lines(lines: DataFrame, fixed: DataFrame) -> DataFrame:
    """(path, line, text): each line, or its first fix with the line's own indentation; nothing is written in place."""
    first = fixed.groupBy("path", "line").agg(F.min_by("fixed", "ord").alias("fixed"))
    indent = F.regexp_extract("text", r"^(\s*)", 1)
    return lines.join(first, ["path", "line"], "left").select("path", "line", F.when(F.col("fixed").isNotNull(), F.concat(indent, F.regexp_replace("fixed", r"^\s+", ""))).otherwise(F.col("text")).alias("text"))


def upgraded(text: Column) -> Column:
    """Parameter sets of the general level replaced by those that CNSA 2.0 asks for."""
    for old, new in (("ML-KEM-768", "ML-KEM-1024"), ("MLKEM768", "MLKEM1024"), ("ML-DSA-65", "ML-DSA-87")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def csv_line(*columns: Column) -> Column:
    """A CSV line: fields with a comma, quote or line end are quoted."""
    field = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *(field(F.coalesce(c.cast("string"), F.lit(""))) for c in columns))


def context(lines: DataFrame, findings: DataFrame, around: int = 15) -> DataFrame:
    """(path, line, ord, context): the lines around a finding with their numbers, the finding's own marked.

    Findings stand among the lines of their file and look around themselves: each row is sorted once, and none meets the lines that are farther away.
    """
    shown = F.concat(F.lpad(F.col("line").cast("string"), 4, " "), F.lit(" | "), F.regexp_replace("text", r"\s+$", ""))
    seen = lines.select("path", "line", F.struct(F.col("line").alias("at"), shown.alias("s")).alias("one"))
    rows = seen.unionByName(findings.select("path", "line", F.struct("ord").alias("finding")), allowMissingColumns=True)
    near = rows.where("path IS NOT NULL AND line IS NOT NULL").withColumn("near", F.collect_list("one").over(W.partitionBy("path").orderBy("line").rangeBetween(-around, around)))
    marked = F.transform("near", lambda x: F.concat(F.when(x["at"] == F.col("line"), ">>> ").otherwise("    "), x["s"]))
    return near.where("finding IS NOT NULL AND size(near) > 0").select("path", "line", F.col("finding.ord").alias("ord"), F.array_join(marked, "\n").alias("context"))


def import_section(lines: DataFrame, first: int = 50) -> DataFrame:
    """(path, line, text): import lines among a file's first lines."""
    return lines.where(F.col("line") <= first).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where(F.col("text").rlike(r"^(import |from |require\(|use |using |require |#include|package )")).select("path", "line", "text")


def _with_rules(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, findings with their rule's index and whether they are the first of all): algorithms numbered by the first place at which each is seen.

    There are as many rules as algorithms in the pattern tables, whatever the number of findings.
    """
    first = findings.groupBy("algorithm").agg(F.min(F.struct("path", "line", "ord")).alias("first_at"))
    rules = first.select("algorithm", "first_at", (F.row_number().over(W.orderBy("first_at")) - 1).cast("long").alias("rule_index"))
    rows = findings.join(rules, "algorithm")
    return rules, rows.withColumn("leads", (F.col("rule_index") == 0) & (F.struct("path", "line", "ord") == F.col("first_at")))


def _frame(spark: SparkSession, head: DataFrame, body: DataFrame, foot: str) -> DataFrame:
    """Text rows of a document in its order: kind 0 head, 1 body by (path, line, ord), 2 foot."""
    none = [F.lit("").alias("path"), F.lit(0).cast("long").alias("line"), F.lit(0).alias("ord")]
    last = spark.range(1).select(F.lit(2).alias("kind"), *none, F.lit(foot).alias("text"))
    return head.select(F.lit(0).alias("kind"), *none, "text").unionByName(body.select(F.lit(1).alias("kind"), "path", "line", "ord", "text")).unionByName(last)


def scan_sarif(findings: DataFrame) -> DataFrame:
    """Text rows (kind, path, line, ord, text) of one SARIF 2.1.0 document for all findings, a result a line; see sources.documents for writing it.

    Rule indices hold for the whole scan. A scan without findings gives a document without rules and results.
    """
    spark = findings.sparkSession
    rules, rows = _with_rules(findings)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rule_index", "algorithm"))), lambda r: F.struct(F.concat(F.lit("PQC-"), r["algorithm"]).alias("id"), r["algorithm"].alias("name")))
    head = rules.agg(F.to_json(listed).alias("rules")).select(F.concat(F.lit('{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"cipherlake","rules":'), "rules", F.lit('}},"results":[')).alias("text"))
    region = F.struct(F.col("line").alias("startLine"), F.struct(F.col("snippet").alias("text")).alias("snippet"))
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    result = F.struct(F.concat(F.lit("PQC-"), "algorithm").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level(F.col("severity")).alias("level"), F.struct(F.concat("algorithm", F.lit(" found")).alias("text")).alias("message"), place.alias("locations"))
    return _frame(spark, head, rows.withColumn("text", F.concat(F.when(F.col("leads"), "").otherwise(","), F.to_json(result))), "]}]}")


def scan_json(findings: DataFrame) -> DataFrame:
    """Text rows of one JSON document for all findings: their number by severity, then a finding a line."""
    counts = F.struct(*(F.coalesce(F.sum((F.col("severity") == s).cast("long")), F.lit(0).cast("long")).alias(s) for s in SEVERITIES))
    head = findings.agg(F.concat(F.lit('{"summary":'), F.to_json(counts), F.lit(',"findings":[')).alias("text"))
    one = F.to_json(F.struct("path", "line", "ord", "algorithm", "severity", "category", "snippet"))
    return _frame(findings.sparkSession, head, _with_rules(findings)[1].withColumn("text", F.concat(F.when(F.col("leads"), "").otherwise(","), one)), "]}")


def scan_text(findings: DataFrame) -> DataFrame:
    """Text rows of one report for all findings under a heading a severity, worst first; kind orders headings and what stands below them."""
    none = [F.lit("").alias("path"), F.lit(0).cast("long").alias("line"), F.lit(0).alias("ord")]
    heads = findings.groupBy("severity").agg(F.count("*").alias("n")).select((2 * rank(F.col("severity"))).cast("int").alias("kind"), *none, F.concat(F.lit("["), "severity", F.lit("] "), F.col("n").cast("string")).alias("text"))
    body = F.concat(F.lit("  "), "algorithm", F.lit(" at "), "path", F.lit(":"), F.col("line").cast("string"), F.lit(": "), "snippet")
    return heads.unionByName(findings.select((2 * rank(F.col("severity")) + 1).cast("int").alias("kind"), "path", "line", "ord", body.alias("text")))
