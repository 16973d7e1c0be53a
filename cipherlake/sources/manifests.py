"""Dependency manifests and lock files of five ecosystems as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cipherlake import dims
from cipherlake.sources import files


def normalised(package: Column) -> Column:
    """Lower case with - and . as _."""
    return F.translate(F.lower(package), "-.", "__")


def _strip(text: Column) -> Column:
    """Without white space at its ends, tabs too."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def manifest_lines(contents: DataFrame) -> DataFrame:
    """(path, line, text) of (path, content)."""
    return contents.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).cast("long").alias("line"), "text")


def _in_section(lines: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """The lines below a header that opens, up to one that closes; neither kind of header is among them."""
    state = F.last(F.when(opens, F.lit(1)).when(closes, F.lit(0)), ignorenulls=True).over(W.partitionBy("path").orderBy("line"))
    return lines.withColumn("inside", state).where((F.col("inside") == 1) & ~opens)


def requirements(contents: DataFrame) -> DataFrame:
    return files.requirements(manifest_lines(contents)).select("path", "line", normalised(F.col("package")).alias("package"), "version")


def pyproject(contents: DataFrame) -> DataFrame:
    """Keys of the two dependency tables; versions are not read."""
    text = _strip(F.col("text"))
    opens = F.col("text").contains("[project.dependencies]") | F.col("text").contains("[tool.poetry.dependencies]")
    name = F.regexp_extract(text, r'^"?([a-zA-Z0-9_.-]+)"?', 1)
    rows = _in_section(manifest_lines(contents), opens, text.startswith("[")).where(name != "")
    return rows.select("path", "line", F.translate(F.lower(name), "-", "_").alias("package"), F.lit(None).cast("string").alias("version"))


def package_json(contents: DataFrame) -> DataFrame:
    return files.package_json(contents).select("path", F.lit(0).cast("long").alias("line"), "package", "version")


def pom(contents: DataFrame) -> DataFrame:
    """group:artifact of neighbouring tags, with the version where it follows."""
    tag = F.lit(r"<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>(?:\s*<version>([^<]+)</version>)?")
    groups, artifacts, versions = (F.regexp_extract_all("content", tag, F.lit(i)) for i in (1, 2, 3))
    found = contents.select("path", F.explode(F.arrays_zip(groups.alias("g"), artifacts.alias("a"), versions.alias("v"))).alias("x"))
    return found.select("path", F.lit(0).cast("long").alias("line"), F.concat_ws(":", "x.g", "x.a").alias("package"), F.nullif(F.col("x.v"), F.lit("")).alias("version"))


def go_mod(contents: DataFrame) -> DataFrame:
    text = _strip(F.col("text"))
    shape = r"^([a-zA-Z0-9./_-]+)\s+v?(\S+)"
    rows = manifest_lines(contents).where(~text.startswith("require") & ~text.startswith(")") & ~text.startswith("module") & text.rlike(shape))
    return rows.select("path", "line", F.regexp_extract(text, shape, 1).alias("package"), F.regexp_extract(text, shape, 2).alias("version"))


def cargo_toml(contents: DataFrame) -> DataFrame:
    """Keys of the dependency tables; versions are not read."""
    text = _strip(F.col("text"))
    opens = F.col("text").contains("[dependencies]") | F.col("text").contains("[dev-dependencies]")
    name = F.regexp_extract(text, r"^([a-zA-Z0-9_-]+)\s*=", 1)
    rows = _in_section(manifest_lines(contents), opens, text.startswith("[") & ~F.col("text").contains("dependencies")).where(name != "")
    return rows.select("path", "line", name.alias("package"), F.lit(None).cast("string").alias("version"))


def _entries(contents: DataFrame, schema: str, sections: Callable[[Column], Column]) -> DataFrame:
    """(path, key, version) of the entries of JSON maps whose values hold a version."""
    parsed = F.from_json("content", schema)
    return contents.select("path", F.explode(sections(parsed)).alias("e")).select("path", F.col("e.key").alias("key"), F.col("e.value.version").alias("version"))


_MAP = "map<string, struct<version: string>>"


def _map(column: Column) -> Column:
    return F.map_entries(F.coalesce(column, F.create_map().cast(_MAP)))


def pipfile_lock(contents: DataFrame) -> DataFrame:
    rows = _entries(contents, f"default {_MAP}, develop {_MAP}", lambda p: F.concat(_map(p["default"]), _map(p["develop"])))
    return rows.select("path", F.lit(0).cast("long").alias("line"), F.translate(F.lower("key"), "-", "_").alias("package"), F.nullif(F.regexp_replace("version", "^=+", ""), F.lit("")).alias("version"))


def package_lock(contents: DataFrame) -> DataFrame:
    """Entries of `packages` without the root's, or of `dependencies` where there are none."""
    rows = _entries(contents, f"packages {_MAP}, dependencies {_MAP}", lambda p: F.when(F.size(_map(p["packages"])) > 0, _map(p["packages"])).otherwise(_map(p["dependencies"])))
    return rows.where("key <> ''").select("path", F.lit(0).cast("long").alias("line"), F.element_at(F.split("key", "node_modules/"), -1).alias("package"), "version")


def _toml_lock(contents: DataFrame) -> DataFrame:
    return files.toml_lock(manifest_lines(contents)).select("path", "line", "package", "version")


def poetry_lock(contents: DataFrame) -> DataFrame:
    """Packages of [[package]] blocks; the line is that of the block's own marker."""
    return _toml_lock(contents).withColumn("package", F.translate(F.lower("package"), "-", "_"))


def yarn_lock(contents: DataFrame) -> DataFrame:
    """A header at the line's start names the package up to its first @, the next version line gives its version and line."""
    header = ~F.col("text").startswith(" ") & ~F.col("text").startswith("#") & F.col("text").contains("@")
    name = F.nullif(F.regexp_replace(_strip(F.get(F.split("text", "@"), F.lit(0))), '^"+|"+$', ""), F.lit(""))
    version = _strip(F.col("text")).startswith("version ")
    value = F.when(F.col("text").contains('"'), F.get(F.split("text", '"'), F.lit(1))).otherwise(F.element_at(F.split(_strip(F.col("text")), r"\s+"), -1))
    events = manifest_lines(contents).withColumns({"package": F.when(header, name), "version": F.when(~header & version, value)}).where("package IS NOT NULL OR version IS NOT NULL")
    before = F.lag("package").over(W.partitionBy("path").orderBy("line"))
    return events.withColumn("before", before).where("version IS NOT NULL AND before IS NOT NULL").select("path", "line", F.col("before").alias("package"), "version")


def go_sum(contents: DataFrame) -> DataFrame:
    return files.go_sum(manifest_lines(contents)).select("path", "line", F.col("module").alias("package"), "version")


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "requirements": requirements, "pyproject": pyproject, "package_json": package_json, "pom": pom, "go_mod": go_mod, "cargo_toml": cargo_toml,
    "pipfile_lock": pipfile_lock, "poetry_lock": poetry_lock, "package_lock": package_lock, "yarn_lock": yarn_lock, "cargo_lock": _toml_lock, "go_sum": go_sum,
}


def dependencies(contents: DataFrame) -> DataFrame:
    """(path, ecosystem, package, version, line, is_transitive) of all manifests and lock files among (path, content), told by their names."""
    name = F.element_at(F.split("path", "/"), -1)
    out = None
    for kind in dict.fromkeys(m[1] for m in dims.MANIFESTS):
        mine = [m for m in dims.MANIFESTS if m[1] == kind]
        rows = PARSERS[kind](contents.where(name.isin([m[0] for m in mine]))).select("path", F.lit(mine[0][2]).alias("ecosystem"), "package", "version", "line", F.lit(mine[0][3]).alias("is_transitive"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the manifests and lock files below root, outside folders that are never scanned."""
    names = "|".join(m[0].replace(".", "\\.") for m in dims.MANIFESTS)
    skipped = "|".join(d.replace(".", "\\.") for d in dims.SKIP_DIRS)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("path").rlike(f"/({names})$") & ~F.col("path").rlike(f"/({skipped})/"))
    return found.select("path", files.text_of(F.col("content")).alias("content"))


def crypto_dependencies(found: DataFrame) -> DataFrame:
    """dependencies() rows with each package of the table that they name: (..., known, risk).

    A dependency matches a known package of its ecosystem if their normalised names are equal or its
    own ends in _ and the known one; maven keys are prefixes of the group. The table is a few dozen
    literals, so the join is a broadcast with a proven size.
    """
    known = dims.frame(found.sparkSession, "packages").select(F.col("ecosystem").alias("of"), F.col("package").alias("known"), "risk")
    mine = normalised(F.col("package"))
    suffix = (mine == F.col("known")) | mine.endswith(F.concat(F.lit("_"), F.col("known")))
    group = F.split(mine, ":")[0]
    prefix = (F.col("ecosystem") == "maven") & ((group == F.col("known")) | group.startswith(F.concat(F.col("known"), F.lit("_"))))
    return found.join(F.broadcast(known), (F.col("ecosystem") == F.col("of")) & (suffix | prefix)).drop("of")
