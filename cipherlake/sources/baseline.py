"""Baselines: the findings of an earlier scan's JSON document, and what is new, still there or gone since."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.functions import lex

_FINDING = "file string, path string, line bigint, algorithm string, category string, severity string"


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, algorithm, category) of the findings of a scan's JSON document, whose file is named `file` or `path`.

    A document with a finding a line, as scan_json writes it, or a folder of its parts, is read line by line; any other one whole.
    What can't be read, or is no such document, has no findings.
    """
    empty = spark.createDataFrame([], "path string, line bigint, algorithm string, category string")
    try:
        lines = spark.read.text(path)
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return empty
    one = lines.select(F.from_json(F.regexp_replace("value", r"^\s*,|,\s*$", ""), f"struct<{_FINDING}>").alias("f")).where("f.algorithm IS NOT NULL AND coalesce(f.file, f.path) IS NOT NULL")
    if one.isEmpty():
        one = whole.select(F.explode(F.from_json("value", f"struct<findings: array<struct<{_FINDING}>>>")["findings"]).alias("f"))
    return one.select(F.coalesce("f.file", "f.path", F.lit("")).alias("path"), F.coalesce("f.line", F.lit(0)).alias("line"), F.coalesce("f.algorithm", F.lit("")).alias("algorithm"), F.coalesce("f.category", F.lit("")).alias("category"))


def compare(current: DataFrame, baseline: DataFrame, root: str) -> DataFrame:
    """The findings of both with their status: new, existing (columns of the current ones) and fixed (columns of the baseline's, others null).

    Findings are told apart by path below root, line, algorithm and category. Of current ones that agree in these the last one
    counts; the baseline's are not merged.
    """
    mark = lex.fingerprint(lex.relative_path(F.col("path"), F.lit(root)), F.col("line"), F.col("algorithm"), F.col("category"))
    now = current.withColumn("mark", mark)
    now = now.groupBy("mark").agg(F.max_by(F.struct(*current.columns), F.struct(*(c for c in ("severity", "ord", "snippet") if c in current.columns))).alias("f")).select("mark", "f.*")
    then = baseline.withColumn("mark", mark)
    status = F.when(F.col("known").isNull(), "new").otherwise("existing").alias("status")
    seen = now.join(then.select("mark").distinct().withColumn("known", F.lit(1)), "mark", "left").select(status, *current.columns)
    gone = then.join(now.select("mark"), "mark", "left_anti").select(F.lit("fixed").alias("status"), "path", "line", "algorithm", "category")
    return seen.unionByName(gone, allowMissingColumns=True)
