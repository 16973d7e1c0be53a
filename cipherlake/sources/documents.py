"""Documents of a whole scan, written in sorted parts that no single task holds together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parts(rows: DataFrame, folder: str) -> None:
    """Writes text rows (kind, path, line, ord, text) as text files that, one after the other by name, are the document."""
    order = ["kind", "path", "line", "ord"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.text(folder)


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The document's lines, in no order."""
    return spark.read.text(folder).select(F.col("value").alias("text"))


def merge_parts(spark: SparkSession, folder: str, target: str) -> None:
    """Streams the parts into one file by the file system of the folder, a buffer at a time; the file takes its name when it is whole."""
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    at, beside, end = (hadoop.fs.Path(p) for p in (folder, target + ".part", target))
    system = at.getFileSystem(conf)
    names = sorted(f.getPath().toString() for f in system.listStatus(at) if f.getPath().getName().startswith("part-"))
    out = system.create(beside, True)
    try:
        for name in names:
            part = system.open(hadoop.fs.Path(name))
            try:
                hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                part.close()
    finally:
        out.close()
    system.delete(end, False)
    system.rename(beside, end)
