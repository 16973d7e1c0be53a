"""Queries over dependency manifests and bills of materials: texts are written from `part`, parsed, and held against `part` itself."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake import dims
from cipherlake.plans import corpus
from cipherlake.sources import manifests

#: Names that the derived manifests hold, per ecosystem: known ones, such with a prefix or other spelling, and others.
NAMES = {
    "pip": ["cryptography", "PyCryptodome", "left-pad", "my-rsa", "google.auth", "numpy", "rsa", "azure-identity", "Requests"],
    "npm": ["node-rsa", "left-pad", "elliptic", "my-jose", "crypto-js", "react", "ssh2"],
    "maven": ["org.bouncycastle:bcprov", "junit:junit", "io.jsonwebtoken:jjwt-api", "com.nimbusds:nimbus-jose", "org.apache.shiro.web:core"],
    "go": ["golang.org/x/crypto", "github.com/pkg/errors", "github.com/cloudflare/circl", "example.org/crypto/rsa"],
    "cargo": ["rsa", "serde", "ed25519-dalek", "my-p256", "ring", "rustls"],
}
#: Entries of a derived manifest at most.
PER = 20


def _entries(spark: SparkSession, sf_dir: str, ecosystem: str) -> DataFrame:
    """(m, pos, k, name, version): the parts of each group of PER keys in order."""
    names = NAMES[ecosystem]
    part = corpus.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = part.select(F.floor(k / PER).alias("m"), k.alias("k"), F.get(F.array(*map(F.lit, names)), (k * 7 % len(names)).cast("int")).alias("name"), F.concat(F.col("p_size").cast("string"), F.lit("."), (k % 5).cast("string")).alias("version"))
    return rows


#: format: (file name, ecosystem, header, entry as SQL over name, version and k, separator, footer).
FORMATS = {
    "requirements": ("requirements.txt", "pip", "", "CASE k % 4 WHEN 0 THEN concat(name, '==', version) WHEN 1 THEN concat('  ', name, ' >= ', version, ', <99') WHEN 2 THEN concat('# ', name) ELSE name END", "\n", ""),
    "pyproject": ("pyproject.toml", "pip", "[build-system]\nrequires = 1\n[tool.poetry.dependencies]\n", "concat(name, ' = \"^', version, '\"')", "\n", "\n[tool.other]\nrsa = 1"),
    "package_json": ("package.json", "npm", '{"name": "x", "dependencies": {', "concat('\"', name, '-', k, '\": \"', version, '\"')", ", ", '}, "devDependencies": {"elliptic": "1"}}'),
    "pom": ("pom.xml", "maven", "<project><dependencies>\n", "concat('<dependency><groupId>', split_part(name, ':', 1), '</groupId>\n <artifactId>', split_part(name, ':', 2), '-', k, '</artifactId>', if(k % 3 = 0, '', concat('<version>', version, '</version>')), '</dependency>')", "\n", "\n</dependencies></project>"),
    "go_mod": ("go.mod", "go", "module example.org/m\nrequire (\n", "concat('\t', name, if(k % 2 = 0, ' v', ' '), version)", "\n", "\n)"),
    "cargo_toml": ("Cargo.toml", "cargo", "[package]\nname = \"m\"\n[dependencies]\n", "if(k % 6 = 0, concat('# ', name), concat(name, ' = \"', version, '\"'))", "\n", "\n[profile]\nrsa = 1"),
    "pipfile_lock": ("Pipfile.lock", "pip", '{"_meta": {}, "default": {', "concat('\"', name, '-', k, '\": {\"hashes\": [], \"version\": \"==', version, '\"}')", ", ", '}, "develop": {"pytest-x": {"version": ""}}}'),
    "poetry_lock": ("poetry.lock", "pip", "# generated\n", "concat('[[package]]\nname = \"', name, '\"\nversion = \"', version, '\"')", "\n", ""),
    "package_lock": ("package-lock.json", "npm", '{"packages": {"": {"version": "0"}, ', "concat('\"', if(k % 2 = 0, 'node_modules/a/', ''), 'node_modules/', name, '-', k, '\": {\"version\": \"', version, '\"}')", ", ", "}}"),
    "yarn_lock": ("yarn.lock", "npm", "# yarn lockfile v1\n\n", "concat(name, '@^', version, ':\n  version \"', version, '\"\n  resolved x')", "\n", "\n"),
    "cargo_lock": ("Cargo.lock", "cargo", "version = 3\n", "concat('[[package]]\nname = \"', name, '\"\nversion = \"', version, '\"')", "\n", ""),
    "go_sum": ("go.sum", "go", "", "concat(name, ' v', version, ' h1:x=\n', name, ' v', version, '/go.mod h1:y=')", "\n", ""),
}


def contents(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(path, content): a manifest for each PER parts."""
    name, ecosystem, header, entry, between, footer = FORMATS[kind]
    rows = _entries(spark, sf_dir, ecosystem).withColumn("entry", F.expr(entry.replace("\n", "\\n").replace("\t", "\\t")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "entry"))), lambda x: x["entry"]), between)
    return rows.groupBy("m").agg(body.alias("body")).select(F.concat(F.lit("m"), F.col("m").cast("string"), F.lit(f"/{name}")).alias("path"), F.concat(F.lit(header), F.col("body"), F.lit(footer)).alias("content"))


def _parsed(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.PARSERS[kind](contents(spark, sf_dir, kind)).select("path", "line", "package", "version")


def all_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in FORMATS:
        one = contents(spark, sf_dir, kind)
        out = one if out is None else out.unionByName(one)
    return out


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifests.crypto_dependencies(manifests.dependencies(all_contents(spark, sf_dir)))
    return found.select("path", "ecosystem", "package", "version", "line", "is_transitive", "known", "risk")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct packages of a lock file by its ecosystem: what a manifest names and what it draws in."""
    found = manifests.dependencies(all_contents(spark, sf_dir))
    return found.groupBy("ecosystem", "is_transitive").agg(F.count("*").alias("n"), F.countDistinct("package").alias("packages"), F.countDistinct("path").alias("files"))


def sbom_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, name, version) read from bills of materials, a JSON document for each PER parts."""
    rows = _entries(spark, sf_dir, "pip")
    body = F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.array_sort(F.collect_list(F.struct("k", F.col("name"), "version"))).alias("components")))
    return read_sbom(rows.groupBy("m").agg(body.alias("content")).select(F.col("m").alias("doc"), "content"))


def read_sbom(documents: DataFrame) -> DataFrame:
    """(doc, name, version) of the components of CycloneDX documents (doc, content); other documents raise."""
    parsed = documents.select("doc", F.from_json("content", "bomFormat string, specVersion string, components array<struct<name: string, version: string>>").alias("p"))
    good = (F.col("p.bomFormat") == "CycloneDX") | F.col("p.components").isNotNull()
    checked = F.when(F.coalesce(good, F.lit(False)), F.coalesce(F.col("p.components"), F.array().cast("array<struct<name: string, version: string>>"))).otherwise(F.raise_error(F.lit("not a bill of materials")).cast("array<struct<name: string, version: string>>"))
    return parsed.select("doc", F.explode(checked).alias("c")).select("doc", "c.name", "c.version")


def enriched(components: DataFrame) -> DataFrame:
    """(doc, name, version, algorithms, status, risk) of components with cryptography: all matching packages' algorithms, sorted."""
    spark = components.sparkSession
    known = dims.frame(spark, "package_algorithms").select(F.col("package").alias("known"), F.explode(F.split("algorithms", ",")).alias("algorithm"))
    known = known.join(dims.frame(spark, "algorithm_states"), "algorithm", "left")
    name: Column = manifests.normalised(F.col("name"))
    rows = components.join(F.broadcast(known), (name == F.col("known")) | name.endswith(F.concat(F.lit("_"), F.col("known"))))
    has = lambda s: F.max((F.col("state") == s).cast("int")) == 1
    out = rows.groupBy("doc", "name", "version").agg(F.array_join(F.sort_array(F.collect_set("algorithm")), ",").alias("algorithms"), has("vulnerable").alias("v"), has("broken").alias("b"), has("weakened").alias("w"))
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = F.when(on("v"), "quantum-vulnerable").when(on("b"), "classically-broken").when(on("w"), "quantum-weakened").otherwise("quantum-safe")
    risk = F.when(on("v") | on("b"), "critical").when(on("w"), "medium").otherwise("low")
    return out.select("doc", "name", "version", "algorithms", status.alias("status"), risk.alias("risk"))


def _sbom_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(sbom_components(spark, sf_dir))


def _base(ecosystem: str) -> str:
    names = NAMES[ecosystem]
    chosen = "[" + ", ".join(map(dims.literal, names)) + f"][1 + (p_partkey * 7) % {len(names)}]"
    return f"e AS (SELECT CAST(floor(p_partkey / {PER}) AS BIGINT) AS m, p_partkey AS k, row_number() OVER (PARTITION BY floor(p_partkey / {PER}) ORDER BY p_partkey) AS pos, {chosen} AS name, CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 5 AS VARCHAR) AS version FROM part)"


def _rows(kind: str) -> str:
    """What a parser must find, from the parts alone: (path, line, package, version)."""
    file, ecosystem, *_ = FORMATS[kind]
    path = f"'m' || CAST(m AS VARCHAR) || '/{file}' AS path"
    norm, dashes = "replace(replace(lower(name), '-', '_'), '.', '_')", "replace(lower(name), '-', '_')"
    select = {
        "requirements": f"SELECT {path}, pos AS line, {norm} AS package, CASE WHEN k % 4 IN (0, 1) THEN version END AS version FROM e WHERE k % 4 <> 2",
        "pyproject": f"SELECT {path}, pos + 3 AS line, {dashes} AS package, CAST(NULL AS VARCHAR) AS version FROM e",
        "package_json": f"SELECT {path}, 0 AS line, name || '-' || CAST(k AS VARCHAR) AS package, version FROM e UNION ALL SELECT DISTINCT {path}, 0, 'elliptic', '1' FROM e",
        "pom": f"SELECT {path}, 0 AS line, name || '-' || CAST(k AS VARCHAR) AS package, CASE WHEN k % 3 <> 0 THEN version END AS version FROM e",
        "go_mod": f"SELECT {path}, pos + 2 AS line, name AS package, version FROM e",
        "cargo_toml": f"SELECT {path}, pos + 3 AS line, name AS package, CAST(NULL AS VARCHAR) AS version FROM e WHERE k % 6 <> 0",
        "pipfile_lock": f"SELECT {path}, 0 AS line, {dashes} || '_' || CAST(k AS VARCHAR) AS package, version FROM e UNION ALL SELECT DISTINCT {path}, 0, 'pytest_x', CAST(NULL AS VARCHAR) FROM e",
        "poetry_lock": f"SELECT {path}, 3 * pos - 1 AS line, {dashes} AS package, version FROM e",
        "package_lock": f"SELECT {path}, 0 AS line, name || '-' || CAST(k AS VARCHAR) AS package, version FROM e",
        "yarn_lock": f"SELECT {path}, 3 * pos + 1 AS line, name AS package, version FROM e",
        "cargo_lock": f"SELECT {path}, 3 * pos - 1 AS line, name AS package, version FROM e",
        "go_sum": f"SELECT {path}, min(2 * pos - 1) AS line, name AS package, version FROM e GROUP BY m, name, version",
    }[kind]
    return f"(WITH {_base(ecosystem)} {select})"


def _all_rows() -> str:
    kinds = {m[1]: m for m in dims.MANIFESTS}
    return "deps AS (" + " UNION ALL ".join(f"SELECT path, '{kinds[k][2]}' AS ecosystem, package, version, CAST(line AS BIGINT) AS line, {str(kinds[k][3]).lower()} AS is_transitive FROM {_rows(k)}" for k in FORMATS) + ")"


_NORM = "replace(replace(lower(d.package), '-', '_'), '.', '_')"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"manifest_{k}": partial(_parsed, k) for k in FORMATS} | {
    "manifest_crypto": _findings,
    "manifest_counts": _counts,
    "sbom_enriched": _sbom_enriched,
}
SQL: dict[str, str] = {f"manifest_{k}": f"SELECT path, CAST(line AS BIGINT) AS line, package, version FROM {_rows(k)}" for k in FORMATS} | {
    "manifest_crypto": f"""WITH {dims.values_sql("packages")}, {_all_rows()}
        SELECT d.path, d.ecosystem, d.package, d.version, d.line, d.is_transitive, k.package AS known, k.risk
        FROM deps d JOIN packages k ON k.ecosystem = d.ecosystem
          AND ({_NORM} = k.package OR right({_NORM}, length(k.package) + 1) = '_' || k.package
            OR (k.ecosystem = 'maven' AND (split_part({_NORM}, ':', 1) = k.package OR starts_with({_NORM}, k.package || '_'))))""",
    "manifest_counts": f"""WITH {_all_rows()}
        SELECT ecosystem, is_transitive, count(*) AS n, count(DISTINCT package) AS packages, count(DISTINCT path) AS files FROM deps GROUP BY ecosystem, is_transitive""",
    "sbom_enriched": f"""WITH {_base("pip")}, {dims.values_sql("package_algorithms")}, {dims.values_sql("algorithm_states")},
        a AS (SELECT DISTINCT e.m AS doc, e.name, e.version, unnest(string_split(p.algorithms, ',')) AS algorithm
          FROM e JOIN package_algorithms p ON replace(replace(lower(e.name), '-', '_'), '.', '_') = p.package
            OR right(replace(replace(lower(e.name), '-', '_'), '.', '_'), length(p.package) + 1) = '_' || p.package),
        s AS (SELECT a.*, t.state FROM a LEFT JOIN algorithm_states t ON t.algorithm = a.algorithm)
        SELECT doc, name, version, string_agg(algorithm, ',' ORDER BY algorithm) AS algorithms,
          CASE WHEN count(*) FILTER (state = 'vulnerable') > 0 THEN 'quantum-vulnerable' WHEN count(*) FILTER (state = 'broken') > 0 THEN 'classically-broken'
            WHEN count(*) FILTER (state = 'weakened') > 0 THEN 'quantum-weakened' ELSE 'quantum-safe' END AS status,
          CASE WHEN count(*) FILTER (state IN ('vulnerable', 'broken')) > 0 THEN 'critical' WHEN count(*) FILTER (state = 'weakened') > 0 THEN 'medium' ELSE 'low' END AS risk
        FROM s GROUP BY doc, name, version""",
}
