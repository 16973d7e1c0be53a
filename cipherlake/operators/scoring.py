"""Risk scores, readiness grades, gates and framework status of findings.

Findings have project, algorithm, severity, category, description and an order (file, line, ord).
Every function groups by project; all reference tables are local relations of a few dozen rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cipherlake import dims

ORDER = ("file", "line", "ord")


def _table(findings: DataFrame, name: str) -> DataFrame:
    return F.broadcast(dims.frame(findings.sparkSession, name))  # fixed literals


def key_size(description: Column) -> Column:
    """The number after key_size=, up to a closing bracket or blank; null where there is none."""
    return F.regexp_extract(description, r"key_size=([^) ]*)", 1).try_cast("int")


def rounded(x: Column, digits: int = 1) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def qars_by_algorithm(findings: DataFrame, sensitivity: str = "internal", exposure: str = "internet") -> DataFrame:
    """(project, algorithm, n, first_at, risk): unknown algorithms have base 0.5; the key factor comes from the algorithm's first finding, 0.7 without a size, 0.5 for an unknown one."""
    order = F.struct(*ORDER)
    per = findings.groupBy("project", "algorithm").agg(F.count("*").alias("n"), F.min(order).alias("first_at"), F.min_by("description", order).alias("d"))
    per = per.withColumn("size", key_size(F.col("d")).cast("long")).join(_table(findings, "base_risk"), "algorithm", "left").join(_table(findings, "size_risk"), "size", "left")
    key = F.when(F.col("size").isNull(), 0.7).otherwise(F.coalesce("factor", F.lit(0.5)))
    risk = F.coalesce("base", F.lit(0.5)) * 0.5 + key * 0.2 + F.lit(dims.SENSITIVITY.get(sensitivity, 0.4)) * 0.15 + F.lit(dims.EXPOSURE.get(exposure, 0.8)) * 0.15
    return per.select("project", "algorithm", "n", "first_at", F.least(F.lit(1.0), risk).alias("risk"))


def mosca_urgency(shelf: float, migration: float, threat: float) -> float:
    return max(0.0, min(1.0, (shelf + migration - threat) / 10.0))


def qars(findings: DataFrame, sensitivity: str = "internal", exposure: str = "internet", shelf: float = 10, migration: float = 3, threat: float = 10) -> DataFrame:
    """(project, score, grade, highest_risk_algo): risks weighted by count, times 1 + urgency / 2, 100 at most; the first seen of the riskiest algorithms."""
    per = qars_by_algorithm(findings, sensitivity, exposure)
    # Integers add up to the same sum in any order.
    risk = F.floor(F.col("risk") * 1_000_000 + 0.5).cast("long")
    out = per.groupBy("project").agg(F.sum(risk * F.col("n")).alias("s"), F.sum("n").alias("n"), F.max_by("algorithm", F.struct(risk, -F.col("first_at.file"), -F.col("first_at.line"), -F.col("first_at.ord"))).alias("highest_risk_algo"))
    score = F.least(F.lit(100.0), F.col("s") / F.col("n") / 1_000_000 * (1 + 0.5 * mosca_urgency(shelf, migration, threat)) * 100)
    out = out.withColumn("score", score)
    grade = F.when(F.col("score") >= 80, "F").when(F.col("score") >= 60, "D").when(F.col("score") >= 40, "C").when(F.col("score") >= 20, "B").otherwise("A")
    return out.select("project", "score", grade.alias("grade"), "highest_risk_algo")


def deadlines(findings: DataFrame, as_of: str) -> DataFrame:
    """(project, algorithm, category, deadline, days, urgency) of each distinct algorithm with a CNSA 2.0 deadline."""
    rules = _table(findings, "compliance").where("framework = 'CNSA 2.0'").join(_table(findings, "deadlines"), "deadline_key")
    days = F.datediff(F.to_date("deadline"), F.lit(as_of).cast("date")).cast("long")
    urgency = F.when(F.col("days") < 0, "OVERDUE").when(F.col("days") < 365, "URGENT").when(F.col("days") < 1095, "APPROACHING").otherwise("DISTANT")
    out = findings.select("project", "algorithm").distinct().join(F.broadcast(rules), "algorithm").withColumn("days", days)
    return out.select("project", "algorithm", F.col("deadline_key").alias("category"), "deadline", "days", urgency.alias("urgency"), "status")


def readiness(findings: DataFrame, as_of: str) -> DataFrame:
    """(project, shor, grover, findings, overdue, urgent, violations, algorithm_score, key_score, compliance_score, score, grade), score unrounded."""
    size = key_size(F.col("description"))
    rsa = F.col("algorithm") == "RSA"
    loss = F.when(rsa & (size < 2048), 30).when(rsa & (size < 4096), 10).otherwise(0) + F.when(F.upper("description").contains("ECB"), 15).otherwise(0) + F.when(F.col("category") == "certificate", 5).otherwise(0)
    # Findings are read once: all else depends on the algorithms that a project has.
    rows = findings.groupBy("project", "algorithm").agg(F.count("*").alias("n"), F.sum(loss).alias("loss"), F.sum((F.col("severity") == "CRITICAL").cast("long")).alias("criticals"))
    listed = _table(findings, "compliance").select(F.lit(0).alias("project"), "algorithm")
    late = deadlines(listed, as_of).groupBy("algorithm").agg(*(F.sum(c.cast("long")).alias(n) for n, c in (("overdue", F.col("urgency") == "OVERDUE"), ("urgent", F.col("urgency") == "URGENT"), ("violations", F.col("status") == "NON-COMPLIANT"))))
    rows = rows.join(_table(findings, "ready_shor").withColumn("is_shor", F.lit(1)), "algorithm", "left").join(_table(findings, "ready_grover").withColumn("is_grover", F.lit(1)), "algorithm", "left").join(F.broadcast(late), "algorithm", "left")
    has = lambda a: F.max((F.col("algorithm") == a).cast("int"))
    many = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("n"))), F.lit(0).cast("long"))
    per = rows.groupBy("project").agg(
        F.sum("n").alias("findings"), many("is_shor").alias("shor"), many("is_grover").alias("grover"), F.sum("loss").alias("loss"),
        has("MD5").alias("md5"), has("RC4").alias("rc4"), has("3DES").alias("des3"), F.sum("criticals").alias("criticals"),
        *(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("overdue", "urgent", "violations")),
    )
    zero = F.lit(0.0)
    algorithm = F.when((F.col("shor") == 0) & (F.col("grover") == 0), 100.0).when(F.col("shor") == 0, F.greatest(zero, 70.0 - F.col("grover") * 3)).otherwise(F.greatest(zero, 40.0 - F.col("shor") / F.col("findings") * 40 - F.col("grover") * 2))
    key = F.greatest(zero, 100.0 - F.col("loss") - F.col("md5") * 20 - F.col("rc4") * 20 - F.col("des3") * 10)
    comply = F.greatest(zero, 100.0 - F.col("overdue") * 20 - F.col("urgent") * 10 - F.col("violations") * 5)
    per = per.withColumns({"algorithm_score": algorithm, "key_score": key, "compliance_score": comply})
    cap = F.least(F.when(F.col("shor") > 0, 74.0).otherwise(100.0), F.when(F.col("overdue") > 0, 59.0).otherwise(100.0), F.when((F.col("md5") == 1) | (F.col("rc4") == 1), 74.0).otherwise(100.0))
    per = per.withColumn("score", F.least(cap, F.col("algorithm_score") * 0.4 + F.col("key_score") * 0.3 + F.col("compliance_score") * 0.3))
    grade = F.when(F.col("score") >= 95, "A+").when(F.col("score") >= 85, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").when(F.col("score") >= 40, "D").otherwise("F")
    return per.withColumn("grade", grade).drop("loss", "md5", "rc4", "des3")


def gate_conditions(findings: DataFrame, as_of: str, names: list[str] | None = None) -> DataFrame:
    """(project, gate, condition, actual, passed) of the named gates (all by default); a gate that isn't known has one condition, which fails."""
    names = names if names is not None else list(dict.fromkeys(g[0] for g in dims.GATES))
    gates = [g for g in dims.GATES if g[0] in names] + [(n, "unknown", "error", "") for n in names if n not in {g[0] for g in dims.GATES}]
    metrics = readiness(findings, as_of).join(qars(findings).select("project", F.col("score").alias("qars")), "project")
    order = F.array(*map(F.lit, ["F", "D", "C", "B", "A", "A+"]))
    limit = F.element_at(F.split("threshold", ":"), -1)
    actual = F.when(F.col("kind") == "count_shor", F.col("shor").cast("string")).when(F.col("kind") == "grade_above", F.col("grade")).when(F.col("kind") == "cnsa_overdue", F.col("overdue").cast("string")).when(F.col("kind") == "cnsa_violations", F.col("violations").cast("string"))
    actual = actual.when(F.col("kind") == "severity_count", F.col("criticals").cast("string")).when(F.col("kind") == "qars_below", rounded(F.col("qars")).cast("string")).otherwise("N/A")
    number = lambda c: F.col(c) <= limit.try_cast("long")
    passed = F.when(F.col("kind") == "count_shor", number("shor")).when(F.col("kind") == "grade_above", F.array_position(order, F.col("grade")) > F.array_position(order, F.col("threshold")))
    passed = passed.when(F.col("kind") == "cnsa_overdue", number("overdue")).when(F.col("kind") == "cnsa_violations", number("violations")).when(F.col("kind") == "severity_count", number("criticals"))
    passed = passed.when(F.col("kind") == "qars_below", rounded(F.col("qars")) < limit.try_cast("double")).otherwise(F.lit(False))
    # Each project meets the few gates: a constant number of rows a project.
    listed = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("gate", "condition", "kind", "threshold"), g))) for g in gates))
    rows = metrics.withColumn("g", F.explode(listed)).select("*", "g.*")
    return rows.select("project", "gate", "condition", actual.alias("actual"), F.coalesce(passed, F.lit(False)).alias("passed"))


def gate_results(findings: DataFrame, as_of: str, names: list[str] | None = None) -> DataFrame:
    """(project, gate, passed): all conditions hold."""
    return gate_conditions(findings, as_of, names).groupBy("project", "gate").agg(F.bool_and("passed").alias("passed"))


def compliance(findings: DataFrame, as_of: str) -> DataFrame:
    """(project, framework, algorithm, status, n, deadline, days, urgency, place): each framework's rows, worst status first, then as first seen."""
    per = findings.groupBy("project", "algorithm").agg(F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("first_at"))
    rows = per.join(_table(findings, "compliance"), "algorithm").join(_table(findings, "deadlines"), "deadline_key", "left")
    cnsa = F.col("framework") == "CNSA 2.0"
    days = F.when(cnsa, F.datediff(F.to_date("deadline"), F.lit(as_of).cast("date")).cast("long"))
    rows = rows.withColumn("days", days).withColumn("shown", F.when(cnsa & F.col("deadline").isNotNull(), F.concat("deadline", F.lit(" ("), "deadline_key", F.lit(")"))).otherwise(F.col("deadline_key")))
    urgency = F.when(F.col("days") < 0, "OVERDUE").when(F.col("days") < 365, "URGENT").when(F.col("days") < 1095, "APPROACHING").when(F.col("days").isNotNull(), "DISTANT")
    rank = F.when(F.col("status") == "NON-COMPLIANT", 0).when(F.col("status") == "DEPRECATED", 1).otherwise(2)
    # At most a row an algorithm in each window.
    place = F.row_number().over(W.partitionBy("project", "framework").orderBy(rank, "first_at"))
    return rows.select("project", "framework", "algorithm", "status", "n", F.col("shown").alias("deadline"), "days", urgency.alias("urgency"), place.cast("long").alias("place"))


def verdicts(findings: DataFrame) -> DataFrame:
    """(project, framework, verdict): FAIL with a non-compliant algorithm, WARN with a deprecated one, else PASS."""
    rows = findings.select("project", "algorithm").distinct().join(_table(findings, "compliance"), "algorithm")
    has = lambda s: F.max((F.col("status") == s).cast("int")) == 1
    return rows.groupBy("project", "framework").agg(F.when(has("NON-COMPLIANT"), "FAIL").when(has("DEPRECATED"), "WARN").otherwise("PASS").alias("verdict"))


def risk_score(findings: DataFrame, by: str = "project") -> DataFrame:
    """(by, risk): 0 without weight, else 100 at most of the whole part of 20 ln(weight + 1)."""
    per = findings.join(_table(findings, "severities"), "severity").groupBy(by).agg(F.sum("weight").alias("raw"))
    return per.select(by, F.when(F.col("raw") <= 0, 0).otherwise(F.least(F.lit(100), F.floor(20 * F.log(F.col("raw") + 1.0)))).cast("long").alias("risk"))
