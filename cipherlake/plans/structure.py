"""Queries of calls by structure and of backward slices over derived sources; SQL from what was put into the sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cipherlake import dims
from cipherlake.operators import slicing, structure
from cipherlake.plans import corpus
from cipherlake.sources.staging import staged

LANGS = ["Java", "Go", "JavaScript", "Rust", "C/C++"]
EXTS = [".java", ".go", ".js", ".rs", ".c"]
#: Lines of a file's head and of each function; call lines are counted from the function's first line.
HEAD, BODY = 6, 9
HEADS = {
    "Java": "package m;\nimport java.security.*;\nclass M {",
    "Go": 'package m\nimport (\n  "crypto/rsa"\n  d "crypto/des"\n)',
    "JavaScript": "'use strict';",
    "Rust": "use rsa::RsaPrivateKey;\nuse std::io;",
    "C/C++": "#include <openssl/rsa.h>",
}
OPENS = {
    "Java": "  public int f@N(int x) throws E {\n    // Cipher.getInstance(\"DES\") {",
    "Go": "func f@N(x int) (int, error) {\n  // rsa.GenerateKey(rand.Reader, 1) {",
    "JavaScript": "function f@N(x) {\n  // crypto.createSign( {",
    "Rust": "fn f@N(x: u32) -> Result<u32, E> {\n  // Sha1::new() {",
    "C/C++": "int f@N(int x) {\n  // RSA_new( {",
}
CLOSES = {"Java": "    return f@M(x);\n  }", "Go": "  return f@M(x)\n}", "JavaScript": "  return f@M(x);\n}", "Rust": "  f@M(x)\n}", "C/C++": "  return f@M(x);\n}"}
#: What stands in a function by kind: (language, kind, text of up to five lines, callees of the text).
TEXTS = [
    ("Java", 0, 'KeyPairGenerator g = KeyPairGenerator.getInstance(\n  "RSA"\n);', ["KeyPairGenerator.getInstance"]),
    ("Java", 1, "g.initialize(\n  3_072,\n  new SecureRandom());", ["g.initialize", "SecureRandom"]),
    ("Java", 2, 'MessageDigest d = MessageDigest.getInstance("MD5" /* ) */);', ["MessageDigest.getInstance"]),
    ("Java", 3, "g.initialize(512);", ["g.initialize"]),
    ("Go", 0, "k, err := rsa.GenerateKey(\n  rand.Reader,\n  2048,\n)", ["rsa.GenerateKey"]),
    ("Go", 1, 'c, _ := d.NewCipher(key(")(", x))', ["d.NewCipher", "key"]),
    ("Go", 2, 'y := other.GenerateKey("rsa.GenerateKey(")', ["other.GenerateKey"]),
    ("Go", 3, "if x > 1 {\n  rsa.GenerateKey(rand.Reader, size(x, 7))\n}", ["rsa.GenerateKey", "size"]),
    ("JavaScript", 0, "crypto.generateKeyPair('rsa', {\n  modulusLength: 4096,\n}, done);", ["crypto.generateKeyPair"]),
    ("JavaScript", 1, "const s = crypto.createSign('SHA256');", ["crypto.createSign"]),
    ("JavaScript", 2, "other.createSign(x);", ["other.createSign"]),
    ("JavaScript", 3, "const e = crypto.createECDH(curve(\n  'secp256k1'));", ["crypto.createECDH", "curve"]),
    ("Rust", 0, "let k = rsa::RsaPrivateKey::new(\n  &mut rng, 2048)?;", ["rsa::RsaPrivateKey::new"]),
    ("Rust", 1, "let h = Sha1::new();", ["Sha1::new"]),
    ("Rust", 2, "let v = other(x);", ["other"]),
    ("Rust", 3, 'let s = "Sha1::new()";', []),
    ("C/C++", 0, "RSA_generate_key_ex(\n  r,\n  1024, e, NULL);", ["RSA_generate_key_ex"]),
    ("C/C++", 1, "EC_KEY *e = EC_KEY_new();", ["EC_KEY_new"]),
    ("C/C++", 2, 'call(RSA_new_like(x), "RSA_new(");', ["call", "RSA_new_like"]),
    ("C/C++", 3, "RSA *r = RSA_new();", ["RSA_new"]),
]
#: What must be found: (language, kind, line in the function, callee, algorithm, severity, category, key size, argument, mode).
FOUND = [
    ("Java", 0, 3, "KeyPairGenerator.getInstance", "RSA", "CRITICAL", "key_exchange", None, "RSA", None),
    ("Java", 1, 3, "g.initialize", "RSA", "CRITICAL", "key_exchange", 3072, None, None),
    ("Java", 2, 3, "MessageDigest.getInstance", "MD5", "HIGH", "hash", None, "MD5", None),
    ("Go", 0, 3, "rsa.GenerateKey", "RSA", "CRITICAL", "key_exchange", 2048, None, None),
    ("Go", 1, 3, "d.NewCipher", "DES", "CRITICAL", "symmetric", None, ")(", None),
    ("Go", 3, 4, "rsa.GenerateKey", "RSA", "CRITICAL", "key_exchange", None, None, None),
    ("JavaScript", 0, 3, "crypto.generateKeyPair", "RSA", "CRITICAL", "key_exchange", 4096, "rsa", None),
    ("JavaScript", 1, 3, "crypto.createSign", "RSA/ECDSA", "HIGH", "signature", None, "SHA256", None),
    ("JavaScript", 3, 3, "crypto.createECDH", "ECDH", "CRITICAL", "key_exchange", None, "secp256k1", None),
    ("Rust", 0, 3, "rsa::RsaPrivateKey::new", "RSA", "CRITICAL", "key_exchange", None, None, None),
    ("Rust", 1, 3, "Sha1::new", "SHA-1", "MEDIUM", "hash", None, None, None),
    ("C/C++", 0, 3, "RSA_generate_key_ex", "RSA", "CRITICAL", "key_exchange", 1024, None, None),
    ("C/C++", 1, 3, "EC_KEY_new", "ECDSA", "CRITICAL", "signature", None, None, None),
    ("C/C++", 3, 3, "RSA_new", "RSA", "CRITICAL", "key_exchange", None, None, None),
]
_KINDS = 4


def _padded(text: str, lines: int) -> str:
    return text + "\n" * (lines - text.count("\n") - 1)


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, content): a file an order, a function a line, its calls by the part's key; calls span lines."""
    items = corpus.numbered(corpus.table(spark, sf_dir, "lineitem"))
    of = F.array(*(F.array(*(F.lit(_padded("\n".join([OPENS[lang], text, CLOSES[lang]]), BODY)) for name, _, text, _ in TEXTS if name == lang)) for lang in LANGS))
    text = F.get(F.get(of, (F.col("l_orderkey") % len(LANGS)).cast("int")), (F.col("l_partkey") % _KINDS).cast("int"))
    text = F.replace(F.replace(text, F.lit("@N"), F.col("line").cast("string")), F.lit("@M"), (F.col("line") + 1).cast("string"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", text.alias("text")))), lambda x: x["text"]), "\n")
    files = items.groupBy("l_orderkey").agg(body.alias("body"))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("l_orderkey") % len(LANGS)).cast("int"))
    head = pick([_padded(HEADS[lang], HEAD) for lang in LANGS])
    return files.select(F.concat(F.lit("src/g"), F.col("l_orderkey").cast("string"), pick(EXTS)).alias("path"), pick(LANGS).alias("language"), F.concat(head, F.lit("\n"), "body").alias("content"))


def _lines(sources: DataFrame) -> DataFrame:
    return sources.select("path", "language", F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def _structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = staged(programs(spark, sf_dir), "programs")
    calls, _ = structure.calls_and_functions(sources)
    return structure.crypto_calls(calls, structure.imports(_lines(sources)))


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.import_findings(structure.imports(_lines(programs(spark, sf_dir))))


def _structure_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.edges(*structure.calls_and_functions(programs(spark, sf_dir)))


#: Text of a line by the part's key: A and B name variables, Q is a number.
ASSIGNED = ['v@A = "S@Q"', "v@A = @Q", "v@A = v@B", 'v@A = cfg.get("k", "D@Q")', 'v@A = cfg["k@Q"]', 'def f(v@A="T@Q", v@B=@Q):', 'if v@A == "no": use(v@B)', 'print(v@A, "v@B = 5")', "v@A = v@B", 'v@A.x = "w"', "    v@A   =   'I@Q'"]


def scripts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines (path, line, text) of a file a supplier, of hundreds of lines, and a target (path, line, var) a line."""
    w = W.partitionBy("l_suppkey").orderBy("l_orderkey", *corpus.ORDER)
    items = corpus.table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(w).cast("long"))
    text = F.get(F.array(*map(F.lit, ASSIGNED)), (F.col("l_partkey") % len(ASSIGNED)).cast("int"))
    for mark, value in (("@A", F.col("l_orderkey") % 4), ("@B", (F.col("l_partkey") + F.col("l_linenumber")) % 4), ("@Q", F.col("l_quantity").cast("long"))):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    path = F.concat(F.lit("src/s"), F.col("l_suppkey").cast("string"), F.lit(".py"))
    # Both tables are read from what is numbered and written once.
    rows = staged(items.select(path.alias("path"), "line", text.alias("text"), F.concat(F.lit("v"), (F.col("l_linenumber") % 4).cast("string")).alias("var")), "scripts")
    return rows.select("path", "line", "text"), rows.select("path", "line", "var")


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.backward_slices(*scripts(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "call_structure_findings": _structural,
    "call_structure_imports": _imported,
    "call_structure_edges": _structure_edges,
    "backward_slices": _slices,
}


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else dims.literal(v)
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({columns}))"


_LIST = lambda values: "[" + ", ".join(map(dims.literal, values)) + "]"
_FUNCTIONS = f"""WITH n AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(corpus.ORDER)}) AS k, l_partkey % {_KINDS} AS kind FROM lineitem),
    g AS (SELECT *, {_LIST(LANGS)}[1 + file % 5] AS language, 'src/g' || file || {_LIST(EXTS)}[1 + file % 5] AS path FROM n)"""
_PASS = """h{k} AS (SELECT o.file, o.line, o.var, arg_max({{'at': e.line, 'form': e.form, 'value': e.value, 'kind': e.kind, 'sure': e.sure, 'met': o.met}}, e.line) AS e
      FROM o{k} o JOIN e ON e.file = o.file AND e.var = o.now AND e.line BETWEEN o.here - 48 AND o.here - 1 AND (e.form <> 3 OR NOT list_contains(o.met, e.value)) GROUP BY o.file, o.line, o.var),
    o{n} AS (SELECT file, line, var, e.at AS here, e.value AS now, list_append(e.met, e.value) AS met FROM h{k} WHERE e.form = 3)"""

SQL: dict[str, str] = {
    "call_structure_findings": _FUNCTIONS + ", " + _values("f", "language, kind, place, callee, algorithm, severity, category, key_size, argument, mode", FOUND) + f" SELECT path, {HEAD} + {BODY} * (k - 1) + place AS line, callee, algorithm, severity, category, CAST(key_size AS BIGINT) AS key_size, argument, CAST(mode AS VARCHAR) AS mode FROM g JOIN f USING (language, kind)",
    "call_structure_imports": _FUNCTIONS + """, i AS (SELECT * FROM (VALUES ('Go', 3, 'RSA', 'key_exchange'), ('Go', 3, 'RSA', 'signature'), ('Go', 4, 'DES', 'symmetric'), ('Go', 4, '3DES', 'symmetric'), ('Rust', 1, 'RSA', 'key_exchange')) AS t(language, line, algorithm, category))
        SELECT DISTINCT path, CAST(line AS BIGINT) AS line, algorithm, 'HIGH' AS severity, category FROM g JOIN i USING (language)""",
    "call_structure_edges": _FUNCTIONS + ", " + _values("t", "language, kind, callee", [(lang, kind, c) for lang, kind, _, callees in TEXTS for c in callees]) + " SELECT DISTINCT 'g' || file || '.f' || k AS caller, callee FROM g JOIN t USING (language, kind) UNION SELECT 'g' || file || '.f' || k, 'f' || (k + 1) FROM g",
    "backward_slices": f"""WITH n AS (SELECT l_suppkey AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, {", ".join(corpus.ORDER)}) AS line, l_partkey % 11 AS kind, 'v' || (l_orderkey % 4) AS a, 'v' || ((l_partkey + l_linenumber) % 4) AS b, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, 'v' || (l_linenumber % 4) AS var FROM lineitem),
    e AS (SELECT file, line, a AS var, 1 AS form, CASE kind WHEN 0 THEN 'S' ELSE 'I' END || q AS value, 'string' AS kind, 'HIGH' AS sure FROM n WHERE kind IN (0, 10)
      UNION ALL SELECT file, line, a, 2, q, 'integer', 'HIGH' FROM n WHERE kind = 1
      UNION ALL SELECT file, line, a, 3, b, 'alias', '' FROM n WHERE kind IN (2, 8)
      UNION ALL SELECT file, line, a, 4, 'D' || q, 'string', 'MEDIUM' FROM n WHERE kind = 3
      UNION ALL SELECT file, line, a, 5, NULL, 'variable', 'LOW' FROM n WHERE kind = 4
      UNION ALL SELECT file, line, a, 6, 'T' || q, 'string', 'MEDIUM' FROM n WHERE kind = 5
      UNION ALL SELECT file, line, b, 7, q, 'integer', 'MEDIUM' FROM n WHERE kind = 5 AND a <> b),
    o1 AS (SELECT file, line, var, line AS here, var AS now, [var] AS met FROM n), {", ".join(_PASS.format(k=k, n=k + 1) for k in (1, 2, 3))},
    h AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)
    SELECT 'src/s' || file || '.py' AS path, line, var, e.value AS value, e.kind AS value_type, e.at AS source_line, e.sure AS confidence FROM h WHERE e.form <> 3""",
}
