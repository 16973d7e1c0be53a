"""Command line: python -m cipherlake scan PATH; exit 0 clean, 1 findings, 2 critical ones, 3 a failed gate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake import dims
from cipherlake.operators import reports, scoring
from cipherlake.operators.match import scan_lines, scan_rules
from cipherlake.sources import baseline, documents, files, manifests
from cipherlake.sources.rules import find_rules
from cipherlake.sources.staging import discard, fresh_path, remove_path, staged

SEVERITIES = [s[0] for s in dims.SEVERITIES]
#: Documents of a whole scan by name.
REPORTS = {"json": reports.scan_json, "text": reports.scan_text, "sarif": reports.scan_sarif}
COLUMNS = ["path", "ext", "language", "line", "ord", "algorithm", "severity", "category", "snippet"]


def located(path: str) -> str:
    return path if "://" in path else f"file://{path}"


def scan(spark: SparkSession, path: str, ignore: list[str] | None = None) -> DataFrame:
    """Findings below a path by the patterns, the built-in rules and the users' rules; suppressed ones are left out.

    Built-in rules add what the patterns do not report at a place; the users' rules add all that they find. Globs of the folder's
    ignore file count beside those given.
    """
    ignore = [*(ignore or []), *files.ignore_patterns(spark, located(path).rstrip("/") + "/.pqcignore")]
    lines = files.lines_of(files.walk(spark, located(path), ignore=ignore))
    found = scan_lines(lines).where("NOT suppressed").select(COLUMNS)
    ruled = lambda rules, first: scan_rules(lines, rules).withColumns({"ord": F.col("rule_ord") + first, "snippet": F.substring(F.trim("text"), 1, 120)}).select(COLUMNS)
    keys = ["path", "line", "algorithm"]
    found = found.unionByName(ruled(dims.RULES, 1000).dropDuplicates(keys).join(found.select(keys).distinct(), keys, "left_anti").select(COLUMNS))
    own = find_rules(path.removeprefix("file://"))
    return (found.unionByName(ruled(own, 2000)) if own else found).withColumn("project", F.lit(0).cast("long"))


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cipherlake")
    p.add_argument("command", choices=["scan", "deps"])
    p.add_argument("path")
    p.add_argument("--format", choices=sorted(REPORTS), default="text")
    p.add_argument("--severity", choices=SEVERITIES, default="LOW", type=str.upper, help="least severity that is reported")
    p.add_argument("--baseline", help="JSON document of an earlier scan: only what is new since is reported")
    p.add_argument("--ignore", action="append", default=[])
    p.add_argument("--output", help="file for the report; it is printed without one")
    p.add_argument("--gate", choices=sorted({g[0] for g in dims.GATES}), help="judges all findings, reported or not")
    p.add_argument("--as-of", default=None, help="date of judgement, today by default")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("cipherlake").getOrCreate()
    if a.command == "deps":
        rows = manifests.crypto_dependencies(manifests.dependencies(manifests.read_manifests(spark, located(a.path)))).orderBy("path", "line", "package")
        n = 0
        for r in rows.toLocalIterator():
            n += 1
            print(f"{r.path}:{r.line} {r.package} {r.version or ''} {r.risk}")
        return int(n > 0)
    every = staged(scan(spark, a.path, a.ignore), "scan")
    found = every.where(reports.rank(F.col("severity")) <= SEVERITIES.index(a.severity) + 1)
    if a.baseline:
        status = baseline.compare(found, baseline.read_baseline(spark, located(a.baseline)), located(a.path))
        counts = {r.status: r["count"] for r in status.groupBy("status").count().collect()}
        print("Baseline: " + ", ".join(f"{counts.get(s, 0)} {s}" for s in ("new", "existing", "fixed")))
        found = status.where("status = 'new'").drop("status")  # of staged findings: comparing twice costs little
    folder = fresh_path(spark, "report")
    documents.write_parts(REPORTS[a.format](found), folder)
    if a.output:
        documents.merge_parts(spark, folder, located(a.output))
    else:
        for r in documents.read_parts(spark, folder).toLocalIterator():
            print(r.text)
    remove_path(spark, folder)
    counts = {r.severity: r["count"] for r in found.groupBy("severity").count().collect()}
    if a.gate:
        as_of = a.as_of or spark.sql("SELECT string(current_date())").first()[0]
        judged = scoring.gate_results(every.withColumns({"file": F.col("path"), "description": F.col("snippet")}), as_of, [a.gate]).collect()
        if not all(r.passed for r in judged):
            return 3
    discard(every)
    return 2 if counts.get("CRITICAL") else int(bool(counts))


if __name__ == "__main__":
    sys.exit(main())
