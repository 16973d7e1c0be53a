"""Queries over syntax trees, calls of other languages and call graphs built from sources; expected rows come from the lines themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake import apis, dims
from cipherlake.operators import calls, graph, pyast
from cipherlake.plans import corpus
from cipherlake.plans.frames import ctes
from cipherlake.sources.staging import staged


def python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of the derived corpus' Python files; a file has a few lines."""
    lines = corpus.source_lines(spark, sf_dir, "Python")
    return lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content"))


#: What each function of a derived module calls, by part key modulo the number of rows: the text of the call.
CALLEES = ["rsa.generate_private_key", "hashlib.md5", "helper", "DES.new", "app.handle_md5", "self.client.close"]


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a module an order, a function a line; function n calls one of CALLEES and function n + 1."""
    items = corpus.numbered(corpus.table(spark, sf_dir, "lineitem"))
    called = F.get(F.array(*map(F.lit, CALLEES)), (F.col("l_partkey") % len(CALLEES)).cast("int"))
    text = F.format_string("def f%d(x):\n    y = %s(x)\n    return f%d(y)\n", "line", called, F.col("line") + 1)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", text.alias("text")))), lambda x: x["text"]), "\n")
    return items.groupBy("l_orderkey").agg(body.alias("content")).select(F.concat(F.lit("src/m"), F.col("l_orderkey").cast("string"), F.lit(".py")).alias("path"), "content")


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each file, not yet distinct over all: enough for what is distinct by node."""
    return pyast.edges_of(modules(spark, sf_dir)).select("caller", "callee")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _called(spark, sf_dir).distinct()


def _ast_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyast.scan_sources(python_sources(spark, sf_dir)).select("path", "line", "algorithm", "severity", "category")


def _call_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calls.scan_calls(corpus.source_lines(spark, sf_dir))
    return found.groupBy("language", "text", "algorithm", "severity", "category").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax tree findings at places that the patterns do not report; they are not deduplicated among themselves."""
    open_ = corpus.findings(spark, sf_dir).where("NOT suppressed").select("path", "line", "algorithm").distinct()
    return _ast_findings(spark, sf_dir).join(open_, ["path", "line", "algorithm"], "left_anti").select("path", "line", "algorithm")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entry_points(_called(spark, sf_dir), apis.ENTRY_NAMES)


def _sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sinks(_called(spark, sf_dir), apis.SINKS)


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = staged(_edges(spark, sf_dir), "edges")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(graph.nodes(edges), "nodes").join(one(edges, "edges"), F.lit(True)).join(one(graph.sinks(edges, apis.SINKS), "sinks"), F.lit(True))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest chain from an entry point to each sink; an entry point that is a sink itself has none."""
    edges = staged(_edges(spark, sf_dir), "edges")  # sources are parsed once, however many jobs read the edges
    paths = graph.shortest_paths(edges, graph.entry_points(edges, apis.ENTRY_NAMES), 10)
    return paths.where("depth > 0").join(graph.sinks(edges, apis.SINKS), "node").select("node", "algorithm", "depth", "path")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = staged(_edges(spark, sf_dir), "edges")  # sources are parsed once, however many jobs read the edges
    paths = graph.shortest_paths(edges, graph.entry_points(edges, apis.ENTRY_NAMES), 10)
    return graph.sinks(edges, apis.SINKS).join(paths.where("depth > 0").select("node"), "node", "left_anti").select("node")


def _crypto_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by name and by the findings of their module, of modules and their syntax tree findings."""
    sources = modules(spark, sf_dir)
    found = pyast.scan_sources(sources).select(F.regexp_extract("path", r"([^/]+)\.py$", 1).alias("module"), "algorithm", F.col("path").alias("file"), "line", F.col("nth").alias("ord"))
    edges = pyast.edges_of(sources).select("caller", "callee")
    return graph.sinks_with_findings(edges, apis.SINKS, found)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest chains over the graph that lineitem spans between suppliers and parts."""
    edges = _layers(spark, sf_dir)
    starts = edges.select(F.col("caller").alias("node")).distinct().join(edges.select(F.col("callee").alias("node")).distinct(), "node", "left_anti")
    return graph.shortest_paths(edges, starts, 10)


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = corpus.table(spark, sf_dir, "lineitem")
    n = lambda shift, key: F.concat(F.lit("n"), (F.col("l_linenumber") + shift).cast("string"), F.lit("_"), (F.col(key) % 10).cast("string"))
    return items.select(n(0, "l_suppkey").alias("caller"), n(1, "l_partkey").alias("callee")).distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ast_findings": _ast_findings,
    "ast_merge": _merged,
    "call_findings": _call_findings,
    "callgraph_python_edges": _edges,
    "callgraph_python_entries": _entries,
    "callgraph_python_sinks": _sinks,
    "callgraph_python_totals": _totals,
    "callgraph_python_chains": _chains,
    "callgraph_python_orphans": _orphans,
    "callgraph_crypto_nodes": _crypto_nodes,
    "callgraph_paths": _paths,
}

#: What the syntax tree of a line must give: (text, algorithm, severity, category).
TREE = [
    ("key = rsa.generate_private_key(public_exponent=65537, key_size=2048)", "RSA", "CRITICAL", "key_exchange"),
    ("digest = hashlib.md5(data).hexdigest()", "MD5", "HIGH", "hash"),
    ("digest = hashlib.sha1(data)  # pqc-ignore", "SHA-1", "MEDIUM", "hash"),
    ("cipher = DES.new(key, DES.MODE_ECB)  # pqc-ignore[RSA, 3DES]", "3DES", "HIGH", "symmetric"),
    ("sign = ec.generate_private_key(ec.SECP256R1())", "ECDSA", "CRITICAL", "signature"),
]
#: What a line of another language must give.
CALLED = [
    ("Java", 'KeyPairGenerator g = KeyPairGenerator.getInstance("RSA");', "RSA", "CRITICAL", "key_exchange"),
    ("Java", 'MessageDigest d = MessageDigest.getInstance("MD5");', "MD5", "HIGH", "hash"),
    ("Java", 'KeyAgreement a = KeyAgreement.getInstance("ECDH");', "ECDH", "CRITICAL", "key_exchange"),
    ("Go", "k, err := rsa.GenerateKey(rand.Reader, 2048)", "RSA", "CRITICAL", "key_exchange"),
    ("Go", "c, _ := des.NewCipher(key)", "DES", "CRITICAL", "symmetric"),
    ("JavaScript", "crypto.generateKeyPair('rsa', { modulusLength: 4096 }, done);", "RSA", "CRITICAL", "key_exchange"),
    ("JavaScript", "const s = crypto.createSign('SHA256');", "RSA/ECDSA", "HIGH", "signature"),
    ("JavaScript", "const e = crypto.createECDH('secp256k1');", "ECDH", "CRITICAL", "key_exchange"),
    ("C/C++", "RSA *r = RSA_new();", "RSA", "CRITICAL", "key_exchange"),
    ("C/C++", "EVP_EncryptInit_ex(c, EVP_aes_128_cbc(), 0, k, iv);", "AES-128", "MEDIUM", "symmetric"),
    ("C/C++", "EC_KEY *e = EC_KEY_new();", "ECDSA", "CRITICAL", "signature"),
    ("Rust", "use rsa::RsaPrivateKey;", "RSA", "CRITICAL", "key_exchange"),
    ("Rust", "let h = Sha1::new();", "SHA-1", "MEDIUM", "hash"),
    ("Rust", "use p256::ecdsa::SigningKey;", "ECDSA", "CRITICAL", "signature"),
]


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(dims.literal, r)) + ")" for r in rows) + f") AS t({columns}))"


_TREE = ctes("lines") + ", " + _values("tree", "text, algorithm, severity, category", TREE)
_FUNCTIONS = f"""WITH n AS (SELECT l_orderkey AS file, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(corpus.ORDER)}) AS line FROM lineitem),
    edges AS (SELECT DISTINCT 'm' || file || '.f' || line AS caller, [{", ".join(map(dims.literal, CALLEES))}][1 + l_partkey % {len(CALLEES)}] AS callee FROM n UNION SELECT 'm' || file || '.f' || line, 'f' || (line + 1) FROM n),
    nodes AS (SELECT caller AS node FROM edges UNION SELECT callee FROM edges),
    {_values("patterns", "place, part, algorithm", [(i, *s) for i, s in enumerate(apis.SINKS)])},
    sinks AS (SELECT node, arg_min(algorithm, place) AS algorithm FROM nodes JOIN patterns ON contains(node, part) GROUP BY node),
    entries AS (SELECT node FROM nodes WHERE node NOT IN (SELECT callee FROM edges) OR {" OR ".join(f"contains(lower(node), '{n}')" for n in apis.ENTRY_NAMES)})"""


def _levels(starts: str, depth: int) -> str:
    """Breadth-first levels written out: a common table expression a level, each with the smallest path to its nodes."""
    out = [f"l0 AS (SELECT node, CAST(0 AS BIGINT) AS depth, node AS path FROM {starts}), r0 AS (SELECT * FROM l0)"]
    for k in range(1, depth + 1):
        out.append(f"l{k} AS (SELECT e.callee AS node, CAST({k} AS BIGINT) AS depth, min(l.path || '>' || e.callee) AS path FROM l{k - 1} l JOIN edges e ON e.caller = l.node WHERE e.callee NOT IN (SELECT node FROM r{k - 1}) GROUP BY e.callee), r{k} AS (SELECT * FROM r{k - 1} UNION ALL SELECT * FROM l{k})")
    return ", ".join(out)


_LAYERS = """WITH edges AS (SELECT DISTINCT 'n' || l_linenumber || '_' || (l_suppkey % 10) AS caller, 'n' || (l_linenumber + 1) || '_' || (l_partkey % 10) AS callee FROM lineitem),
    starts AS (SELECT DISTINCT caller AS node FROM edges WHERE caller NOT IN (SELECT callee FROM edges))"""

SQL: dict[str, str] = {
    "ast_findings": _TREE + " SELECT l.path, l.line, t.algorithm, t.severity, t.category FROM lines l JOIN tree t ON t.text = l.text WHERE l.language = 'Python'",
    "ast_merge": ctes("findings") + ", " + _values("tree", "text, algorithm, severity, category", TREE) + """ SELECT l.path, l.line, t.algorithm FROM lines l JOIN tree t ON t.text = l.text
        LEFT JOIN (SELECT DISTINCT path, line, algorithm FROM findings WHERE NOT suppressed) f ON f.path = l.path AND f.line = l.line AND f.algorithm = t.algorithm WHERE l.language = 'Python' AND f.path IS NULL""",
    "call_findings": ctes("lines") + ", " + _values("called", "language, text, algorithm, severity, category", CALLED) + " SELECT language, text, algorithm, severity, category, count(*) AS n, count(DISTINCT file) AS files FROM lines JOIN called USING (language, text) GROUP BY ALL",
    "callgraph_python_edges": _FUNCTIONS + " SELECT caller, callee FROM edges",
    "callgraph_python_entries": _FUNCTIONS + " SELECT node FROM entries",
    "callgraph_python_sinks": _FUNCTIONS + " SELECT node, algorithm FROM sinks",
    "callgraph_python_totals": _FUNCTIONS + " SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM sinks) AS sinks",
    "callgraph_python_chains": f"{_FUNCTIONS}, {_levels('entries', 3)} SELECT r.node, s.algorithm, r.depth, r.path FROM r3 r JOIN sinks s ON s.node = r.node WHERE r.depth > 0",
    "callgraph_python_orphans": f"{_FUNCTIONS}, {_levels('entries', 3)} SELECT node FROM sinks WHERE node NOT IN (SELECT node FROM r3 WHERE depth > 0)",
    "callgraph_crypto_nodes": _FUNCTIONS + """, hits AS (SELECT 'm' || file AS module, CASE l_partkey % 6 WHEN 0 THEN 'RSA' WHEN 1 THEN 'MD5' ELSE '3DES' END AS algorithm, 'src/m' || file || '.py' AS file, 4 * line - 2 AS line FROM n WHERE l_partkey % 6 IN (0, 1, 3)),
        last AS (SELECT module, arg_max(algorithm, line) AS algorithm, any_value(file) AS file, max(line) AS line FROM hits GROUP BY module)
        SELECT o.node, coalesce(l.algorithm, s.algorithm) AS algorithm, l.file, l.line FROM nodes o LEFT JOIN last l ON l.module = split_part(o.node, '.', 1) LEFT JOIN sinks s ON s.node = o.node WHERE l.module IS NOT NULL OR s.node IS NOT NULL""",
    "callgraph_paths": f"{_LAYERS}, {_levels('starts', 8)} SELECT node, depth, path FROM r8",
}
