"""Scans and windowed counts over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.operators.match import scan_lines
from cipherlake.sources.staging import fresh_path


def scan_stream(lines: DataFrame) -> DataFrame:
    """Findings of a stream of (language, text, ...) lines: the same stateless plan as a batch scan."""
    return scan_lines(lines)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, with an event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(day, event_type, n) in tumbling windows; state older than the watermark is dropped."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def tumbling_findings(lines: DataFrame, width: str = "30 days", late: str = "60 days") -> DataFrame:
    """(day, algorithm, n): findings of a stream of (language, text, ts, ...) lines in tumbling windows."""
    found = scan_lines(lines).where("NOT suppressed").withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "algorithm").agg(F.count("*").alias("n"))
    return found.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "algorithm", "n")


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Processes what is there now and returns the result, written to the shared folder batch by batch, not held by the driver."""
    path = fresh_path(stream.sparkSession, "sink")
    query = stream.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite" if mode == "complete" else "append").parquet(path)).outputMode(mode).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
