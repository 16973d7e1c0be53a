"""Queries over streams: the limiter over micro-batches of `events` and scans of a stream of source lines; SQL states the rows of the batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.plans import corpus
from cipherlake.plans.frames import ctes
from cipherlake.sources.staging import fresh_path
from cipherlake.streaming import continuous, limits

LIMIT, WINDOW = 2, 86_400
#: Parts that the events come in and days by which a call may come late.
PARTS, DISORDER = 4, 3


def _call_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Events as files that come part by part, out of order by DISORDER days and by what a part spans, then a heartbeat a year later; and that delay."""
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    calls = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), ts.alias("ts"))
    comes = F.col("ts").cast("double") + F.col("id") % DISORDER * 86_400
    ends = calls.agg(F.min(comes).alias("low"), F.max(comes).alias("high")).first()
    width, folder = ((ends["high"] or 0) - (ends["low"] or 0) + 1) / PARTS, fresh_path(spark, "calls")
    for i in range(PARTS):
        calls.where(F.floor((comes - (ends["low"] or 0)) / width) == i).write.parquet(f"{folder}/part{i}")
    beat = spark.range(1).select(F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("id"), F.timestamp_seconds(F.lit((ends["high"] or 0) + 366 * 86_400)).alias("ts"))
    beat.write.parquet(f"{folder}/part{PARTS}")
    files = sum(f.endswith(".parquet") for f, _, _ in corpus.files_of(spark, folder))
    stream = spark.readStream.schema(calls.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", -(-files // PARTS)).parquet(folder)
    return stream, f"{int(width) + DISORDER * 86_400} seconds"


def _limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch opens the stores of all state partitions and starts Python for them: two a core are enough, whatever a shuffle of rows needs."""
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    held = {name: spark.conf.get(name) for name in names}
    limits.use_state_lists(spark)
    spark.conf.set(names[1], min(int(held[names[1]]), 2 * spark.sparkContext.defaultParallelism))
    try:
        calls, delay = _call_stream(spark, sf_dir)
        judged = continuous.run_once(limits.accepts_stream(calls, LIMIT, WINDOW, delay), "append")
    finally:
        for name in names:
            spark.conf.set(name, held[name])
    return judged.groupBy("key").agg(F.count("*").alias("calls"), F.sum(F.col("accepted").cast("long")).alias("accepted"))


def _line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived source lines as a file stream, with their order's date as event time."""
    path = fresh_path(spark, "lines")
    dates = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    corpus.source_lines(spark, sf_dir).join(dates, "file").write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = continuous.run_once(continuous.scan_stream(_line_stream(spark, sf_dir)), "append")
    return found.select("path", "line", "ord", "algorithm", "severity", "suppressed")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuous.run_once(continuous.tumbling_findings(_line_stream(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stream_rate_limit": _limiter, "stream_scan": _scan, "stream_finding_windows": _windows}

SQL: dict[str, str] = {
    "stream_scan": ctes("findings") + " SELECT path, line, ord, algorithm, severity, suppressed FROM findings",
    "stream_finding_windows": ctes("findings") + """, d AS (SELECT f.algorithm, CAST(o.o_orderdate AS DATE) AS day FROM findings f JOIN orders o ON o.o_orderkey = f.file WHERE NOT suppressed)
        SELECT strftime(DATE '1970-01-01' + CAST(date_diff('day', DATE '1970-01-01', day) // 30 * 30 AS INTEGER), '%Y-%m-%d') AS day, algorithm, count(*) AS n FROM d GROUP BY 1, 2""",
}
