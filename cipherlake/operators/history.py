"""The scan history as a Parquet table: append, retention, import of older records, rollups and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "scan_id long, ts timestamp_ntz, project string, scanner string, files_scanned long, total long, critical long, high long, medium long, low long, risk long, grade string, algorithms array<string>"
#: Scans kept of each project.
KEEP = 1000


def append(scans: DataFrame, folder: str) -> None:
    """Adds scans to the history; Spark's committer makes a batch visible whole or not at all."""
    scans.write.mode("append").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The history; a folder that isn't there is an empty one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(folder)


def retained(history: DataFrame, keep: int = KEEP) -> DataFrame:
    """The newest `keep` scans of each project."""
    newest = F.row_number().over(W.partitionBy("project").orderBy(F.col("ts").desc(), F.col("scan_id").desc()))
    return history.withColumn("_k", newest).where(F.col("_k") <= keep).drop("_k")


def tolerant_time(text: Column) -> Column:
    """ISO time of the first 19 characters; what can't be read is the smallest time, so it sorts first."""
    return F.coalesce(F.try_to_timestamp(F.substring(text, 1, 19)).cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def import_json(lines: DataFrame) -> DataFrame:
    """History rows of JSON lines (value) of the older store; malformed lines and such without a project are left out, unknown keys dropped."""
    parsed = lines.select(F.from_json("value", "scan_id long, scan_date string, scan_path string, scanner string, risk_score long, grade string, total_findings long, critical long, high long, medium long, low long, files_scanned long, algorithms map<string, long>", {"mode": "PERMISSIVE"}).alias("p")).where("p.scan_path IS NOT NULL")
    base = F.element_at(F.split("p.scan_path", "/"), -1)
    zero = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(0).cast("long"))
    return parsed.select(
        F.col("p.scan_id").alias("scan_id"), tolerant_time(F.col("p.scan_date")).alias("ts"), F.coalesce(F.nullif(base, F.lit("")), "p.scan_path").alias("project"), F.col("p.scanner").alias("scanner"), zero("files_scanned").alias("files_scanned"), zero("total_findings").alias("total"),
        *(zero(c).alias(c) for c in ("critical", "high", "medium", "low")), zero("risk_score").alias("risk"), F.coalesce("p.grade", F.lit("?")).alias("grade"), F.sort_array(F.map_keys(F.coalesce("p.algorithms", F.create_map().cast("map<string, long>")))).alias("algorithms"),
    )


def migrate(older: DataFrame, folder: str) -> bool:
    """Imports older rows once: only while the history is empty."""
    if not read(older.sparkSession, folder).isEmpty():
        return False
    append(older, folder)
    return True


def scanners(history: DataFrame) -> DataFrame:
    """(scanner, scans, avg_risk, findings, last_scan): whole part of the mean risk, day of the last scan."""
    return history.groupBy("scanner").agg(F.count("*").alias("scans"), F.floor(F.sum("risk") / F.count("*")).cast("long").alias("avg_risk"), F.sum("total").alias("findings"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_scan"))


def projects(history: DataFrame) -> DataFrame:
    """(project, scans, first_scan, last_scan)."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return history.groupBy("project").agg(F.count("*").alias("scans"), day(F.min("ts")).alias("first_scan"), day(F.max("ts")).alias("last_scan"))


def latest(history: DataFrame) -> DataFrame:
    """(project, scans, risk, total, grade, risk_delta, total_delta, critical_delta, arrow) of each project's last scan against the one before."""
    order = W.partitionBy("project").orderBy("ts", "scan_id")
    back = W.partitionBy("project").orderBy(F.col("ts").desc(), F.col("scan_id").desc())
    rows = history.select("*", *((F.col(c) - F.lag(c).over(order)).alias(f"{c}_delta") for c in ("risk", "total", "critical")), F.row_number().over(back).alias("k"), F.count("*").over(W.partitionBy("project")).alias("scans")).where("k = 1")
    arrow = F.when(F.col("risk_delta") > 0, "up").when(F.col("risk_delta") < 0, "down").otherwise("flat")
    return rows.select("project", "scans", "risk", "total", "grade", "risk_delta", "total_delta", "critical_delta", arrow.alias("arrow"))


def newest(history: DataFrame, limit: int = 10) -> DataFrame:
    """The newest `limit` scans of each project with their place, oldest first (place 1 is the oldest of them)."""
    back = W.partitionBy("project").orderBy(F.col("ts").desc(), F.col("scan_id").desc())
    rows = history.withColumn("k", F.row_number().over(back)).where(F.col("k") <= limit)
    return rows.withColumn("place", (F.max("k").over(W.partitionBy("project")) - F.col("k") + 1).cast("long")).drop("k")


def trends(history: DataFrame, limit: int = 10) -> DataFrame:
    """(project, scans, direction, delta_risk, delta_findings, sparkline) over the newest `limit` scans; a change of more than 5 counts."""
    rows = newest(history, limit).groupBy("project").agg(F.array_sort(F.collect_list(F.struct("place", "risk", "total"))).alias("s"))  # at most `limit` a project
    first, last = F.get("s", F.lit(0)), F.element_at("s", -1)
    many = F.size("s") >= 2
    delta = F.when(many, last["risk"] - first["risk"]).otherwise(0)
    direction = F.when(~many, "unknown").when(delta < -5, "improving").when(delta > 5, "declining").otherwise("stable")
    return rows.select("project", F.size("s").cast("long").alias("scans"), direction.alias("direction"), delta.alias("delta_risk"), F.when(many, last["total"] - first["total"]).otherwise(0).alias("delta_findings"), sparkline(F.transform("s", lambda x: x["risk"])).alias("sparkline"))


# The eight levels of a text sparkline.
LEVELS = " _.-~*=#"


def sparkline(values: Column, width: int = 20) -> Column:
    """A character a value by its place between the least and the largest; more than `width` values are thinned out evenly."""
    n = F.size(values)
    some = F.when(n > width, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(values, F.floor(i * n / width).cast("int")))).otherwise(values)
    low, span = F.array_min(values), F.greatest(F.array_max(values) - F.array_min(values), F.lit(1))
    return F.array_join(F.transform(some, lambda v: F.substring(F.lit(LEVELS), F.least(F.lit(8), F.floor((v - low) * 7 / span).cast("int") + 1), F.lit(1))), "")


def stacked(history: DataFrame) -> DataFrame:
    """(project, scan_id, severity, count, base): each severity's bar of a scan begins where those before it end."""
    names = ["critical", "high", "medium", "low"]
    parts = F.array(*(F.struct(F.lit(n).alias("severity"), F.col(n).alias("count"), sum((F.col(m) for m in names[:i]), F.lit(0)).cast("long").alias("base")) for i, n in enumerate(names)))
    return history.select("project", "scan_id", F.explode(parts).alias("p")).select("project", "scan_id", "p.*")
