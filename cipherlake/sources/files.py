"""Source files, ignore files, baselines and manifests as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cipherlake import dims
from cipherlake.functions import lex


def text_of(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 is left out."""
    return F.translate(F.make_valid_utf8(content.cast("string")), "\ufffd", "")


def walk(spark: SparkSession, root: str, max_files: int | None = None, ignore: list[str] | None = None) -> DataFrame:
    """(path, ext, language, content) of the source files below root.

    Folders that are never scanned and ignored globs are left out before content is read; files of
    unknown extension are not counted. max_files is the scan's own limit, off by default: the first in
    path order, chosen before any content is read. Bytes that are not UTF-8 are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.where(~F.col("path").rlike("/(" + "|".join(d.replace(".", "\\.") for d in dims.SKIP_DIRS) + ")/"))
    for glob in ignore or []:
        rule = lex.glob_regex(glob)
        files = files.where(~(F.col("path").rlike(rule.replace("^", "^(.*/)?", 1)) | F.element_at(F.split("path", "/"), -1).rlike(rule)))
    known = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{e}', '{n}')" for e, n in dims.EXTENSIONS) + " AS t(ext, language)")
    files = files.withColumn("ext", F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))).join(F.broadcast(known), "ext")
    if max_files is not None:
        chosen = files.select("path").orderBy("path").limit(max_files)
        files = files.join(chosen, "path", "left_semi")
    return files.select("path", "ext", "language", text_of(F.col("content")).alias("content"))


def lines_of(files: DataFrame) -> DataFrame:
    """(path, ext, language, line, text): split on line feeds only; block comments are stripped over the whole file first, so text is what is matched against."""
    stripped = lex.strip_blocks(F.col("content"), F.col("language"))
    return files.select("path", "ext", "language", F.posexplode(F.split(stripped, "\n")).alias("at", "text")).select("path", "ext", "language", (F.col("at") + 1).cast("long").alias("line"), "text")


def ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """Globs of an ignore file: its lines that are neither blank nor comments; none where there is no such file.

    Read by the file system itself, as Spark's readers pass over files whose name begins with a dot.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    stream = system.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [line.strip() for line in text.split("\n") if line.strip() and not line.strip().startswith("#")]


def requirements(lines: DataFrame) -> DataFrame:
    """(path, line, package, version) of requirement lines; comments and options are skipped."""
    text = F.trim("text")
    rows = lines.where(~text.startswith("#") & ~text.startswith("-") & (text != ""))
    return rows.select("path", "line", F.regexp_extract(text, r"^([A-Za-z0-9_.\-]+)", 1).alias("package"), F.nullif(F.regexp_extract(text, r"^[A-Za-z0-9_.\-]+(?:\[[^\]]*\])?\s*(?:[=<>!~]=?)\s*([^\s,;#]+)", 1), F.lit("")).alias("version")).where("package <> ''")


def package_json(files: DataFrame) -> DataFrame:
    """(path, package, version) of the three dependency sections of package.json contents."""
    parsed = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    sections = [F.map_entries(F.coalesce(parsed[s], empty)) for s in ("dependencies", "devDependencies", "peerDependencies")]
    return files.select("path", F.explode(F.concat(*sections)).alias("e")).select("path", F.col("e.key").alias("package"), F.col("e.value").alias("version"))


def toml_lock(lines: DataFrame) -> DataFrame:
    """(path, line, package, version) of [[package]] blocks: a running block number, then the block's name and version."""
    value = lambda key: F.nullif(F.regexp_extract("text", rf'^{key}\s*=\s*"([^"]*)"', 1), F.lit(""))
    block = F.sum((F.trim("text") == "[[package]]").cast("int")).over(W.partitionBy("path").orderBy("line"))
    rows = lines.withColumn("block", block).where("block > 0")
    return rows.groupBy("path", "block").agg(F.min("line").alias("line"), F.first(value("name"), True).alias("package"), F.first(value("version"), True).alias("version")).where("package IS NOT NULL").select("path", "line", "package", "version")


def go_sum(lines: DataFrame) -> DataFrame:
    """(path, module, version, line): one row a module and version, whatever the number of its checksums."""
    part: Column = F.split("text", " ")
    rows = lines.where(F.size(part) >= 2).select("path", F.get(part, F.lit(0)).alias("module"), F.regexp_replace(F.regexp_replace(F.get(part, F.lit(1)), "/go\\.mod$", ""), "^v", "").alias("version"), "line")
    return rows.groupBy("path", "module", "version").agg(F.min("line").alias("line"))
