"""The derived code corpus and its findings as DataFrames over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cipherlake import dims
from cipherlake.operators.match import scan_lines
from cipherlake.operators.once import once
from cipherlake.sources.staging import staged

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt evenly over all cores, for long work on each: a small file would be read by few tasks."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def numbered(items: DataFrame) -> DataFrame:
    """lineitem with a line number in each order; equal rows are interchangeable."""
    return items.withColumn("line", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER)).cast("long"))


def source_lines(spark: SparkSession, sf_dir: str, language: str | None = None) -> DataFrame:
    """(project, file, line, language, ext, path, text, flag): a file an order, a line a lineitem row; of one language, its rows are chosen before lines are numbered."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    if language is not None:
        items = items.where((F.col("l_orderkey") % 8).isin([i for i, name, _ in dims.LANGUAGES if name == language]))
    lines = numbered(items).select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "line")
    langs, texts = dims.frame(spark, "languages"), dims.frame(spark, "templates")
    counts = texts.select("language", "n_templates").distinct()
    lines = lines.withColumn("lang_no", F.col("l_orderkey") % 8).join(F.broadcast(langs.join(counts, "language")), "lang_no")
    lines = lines.withColumn("template_no", (F.col("l_partkey") * 31 + F.col("l_suppkey")) % F.col("n_templates")).join(F.broadcast(texts.drop("n_templates")), ["language", "template_no"])
    lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 50).alias("project")), "l_orderkey")
    path = F.concat(F.lit("p"), F.col("project").cast("string"), F.lit("/"), F.when(F.col("l_orderkey") % 5 == 0, "tests/").otherwise("src/"), F.lit("f"), F.col("l_orderkey").cast("string"), F.col("ext"))
    return lines.select("project", F.col("l_orderkey").alias("file"), "line", "language", "ext", path.alias("path"), "text", F.col("l_returnflag").alias("flag"))


#: Where the findings of a table folder were written by this application: reports read what one scan wrote, as long as the tables are the same files.
_SCANNED: dict[tuple[str, str], tuple[tuple, str, StructType]] = {}


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of each file of a table, by any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, file, path, line, language, ext, ord, algorithm, severity, category, snippet, suppressed, flag) of every matching pattern; equal lines of a language are matched once."""
    matched = lambda texts: scan_lines(texts.withColumn("same", F.col("text"))).withColumnRenamed("same", "text")
    return once(source_lines(spark, sf_dir), ["language", "text"], matched, "matched").drop("text")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of scan(), scanned and written once an application and read by every report after that; scanned anew if a file of the tables has changed."""
    key, state = (spark.sparkContext.applicationId, sf_dir), tuple(files_of(spark, f"{sf_dir}/lineitem.parquet") + files_of(spark, f"{sf_dir}/orders.parquet"))
    if key in _SCANNED and _SCANNED[key][0] == state:
        _, path, schema = _SCANNED[key]
        at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.read.schema(schema).parquet(path)
    out = staged(scan(spark, sf_dir), "findings")
    _SCANNED[key] = (state, out.staged_at, out.schema)
    return out
