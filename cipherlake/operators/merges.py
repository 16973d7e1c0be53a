"""Filters and merges of findings with other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake import dims


def without_false_positives(findings: DataFrame, triage: DataFrame, keys: list[str], sure: float = 0.7) -> DataFrame:
    """Findings that triage (keys, is_false_positive, confidence) doesn't call false with at least that confidence."""
    gone = triage.where(F.col("is_false_positive") & (F.col("confidence") >= sure)).select(*keys).distinct()
    return findings.join(gone, keys, "left_anti")


def described(findings: DataFrame, better: DataFrame, keys: list[str]) -> DataFrame:
    """Findings with the description of `better` (keys, description) where there is another one."""
    other = better.groupBy(*keys).agg(F.max("description").alias("_better"))
    return findings.join(other, keys, "left").withColumn("description", F.coalesce("_better", "description")).drop("_better")


def algorithms_of(findings: DataFrame, by: str) -> DataFrame:
    """(by, algorithms, shor): sorted distinct algorithms, and those that Shor's method breaks."""
    rows = findings.groupBy(by).agg(F.sort_array(F.collect_set("algorithm")).alias("algorithms"))  # a few dozen names at most
    return rows.select(by, "algorithms", F.array_intersect("algorithms", F.array(*map(F.lit, dims.READY_SHOR))).alias("shor"))


def accuracy(files: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision_, recall, f1) of files (expected, found: arrays of algorithms), over all files; shares rounded to four places, 0 where nothing is counted."""
    n = lambda c: F.sum(F.size(c)).cast("long")
    t = files.agg(n(F.array_intersect("expected", "found")).alias("tp"), n(F.array_except("found", "expected")).alias("fp"), n(F.array_except("expected", "found")).alias("fn"))
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    t = t.withColumns({"p": share(F.col("tp"), F.col("tp") + F.col("fp")), "r": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    four = lambda c: F.floor(c * 10_000 + 0.5) / 10_000
    return t.select("tp", "fp", "fn", four(F.col("p")).alias("precision_"), four(F.col("r")).alias("recall"), four(share(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))).alias("f1"))


def success_rate(outcomes: DataFrame, expected: list[int]) -> DataFrame:
    """(shots, hits, rate) of outcomes (outcome): the share of expected ones, in four places."""
    counts = outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("outcome").isin(expected), F.col("n")).otherwise(0))
    return counts.agg(F.sum("n").alias("shots"), hit.alias("hits"), (F.floor(hit / F.sum("n") * 10_000 + 0.5) / 10_000).alias("rate"))
