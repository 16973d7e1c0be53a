"""Queries over protocol bytes written from `events` and `part`, and over comment families of whole texts; SQL states what was put in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.functions import lex
from cipherlake.functions import protocols as p
from cipherlake.plans import corpus


def _hex(value, size: int):
    return F.lpad(F.hex(value), 2 * size, "0")


def _hellos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ServerHello an event: session ids of 0 to 4 bytes, 0 to 2 extensions."""
    e = F.col("event_id")
    suite = F.get(F.array(*(F.lit(s) for s, _ in p.SUITES)), (e % 16).cast("int"))
    extensions = F.when(e % 3 == 0, F.lit("")).when(e % 3 == 1, F.lit("002B00020304")).otherwise(F.concat(F.lit("002B00020304"), F.lit("00330001"), _hex(e % 256, 1)))
    body = F.concat(F.lit("0303"), F.repeat(_hex(e % 256, 1), 32), _hex(e % 5, 1), F.expr("repeat('AB', CAST(event_id % 5 AS INT))"), _hex(F.coalesce(suite, F.lit(0x1234)), 2), F.lit("00"), F.when(e % 3 == 0, "").otherwise(_hex(F.floor(F.length(extensions) / 2).cast("long"), 2)), extensions)
    rows = corpus.table(spark, sf_dir, "events").select("event_id", F.unhex(body).alias("body"))
    rows = rows.withColumn("h", p.server_hello(F.col("body"))).withColumn("name", p.name_of(p.SUITES, F.col("h.suite")))
    return rows.select("event_id", F.col("h.version").alias("version"), F.col("h.session_id").alias("session_id"), "name", F.array_join(F.transform("h.extensions", lambda x: F.concat_ws(":", x["kind"].cast("string"), x["length"].cast("string"))), ",").alias("extensions"))


def _handshakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of seven times the event's id in bytes: what doesn't fit into a message of three length bytes goes into further ones."""
    e, most = F.col("event_id"), (1 << 24) - 1
    kind, full = _hex(e % 256, 1), F.floor(e * 7 / most).cast("int")
    headers = F.concat(F.repeat(F.concat(kind, F.lit("FFFFFF")), full), kind, _hex(e * 7 % most, 3))
    rows = corpus.table(spark, sf_dir, "events").select("event_id", p.handshakes(F.unhex(headers)).alias("h"))
    return rows.select("event_id", "h.kind", "h.length")


def _suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n,) for _, n in p.SUITES], "name string")
    return rows.select("name", p.suite_parts(F.col("name")).alias("s")).select("name", "s.*")


def _ssh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A public key line a part: RSA keys of several sizes, and other types."""
    k = F.col("p_partkey")
    kind = F.get(F.array(*(F.lit(x) for x, *_ in p.SSH_TYPES)), (k % 9).cast("int"))
    bytes_ = 129 + k % 4 * 64
    blob = F.concat(_hex(F.length(kind).cast("long"), 4), F.hex(F.encode(kind, "UTF-8")), F.lit("00000003010001"), _hex(bytes_, 4), F.lit("00FF"))
    line = F.concat(kind, F.lit(" "), F.base64(F.unhex(blob)), F.lit(" user@host "), k.cast("string"))
    return corpus.table(spark, sf_dir, "part").select("p_partkey", p.public_key(line).alias("x")).select("p_partkey", "x.*")


def _system(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = F.get(F.array(*map(F.lit, ["CRITICAL", "HIGH", "MEDIUM", "SAFE", "INFO", "OTHER"])), (F.col("p_partkey") % 6).cast("int"))
    rows = corpus.table(spark, sf_dir, "part").select("p_brand", risk.alias("risk"))
    return p.system_score(rows, "p_brand")


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put between and inside comments of each family; what is left of them without comments."""
    docs = corpus.spread(corpus.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.translate(F.coalesce("text", F.lit("")), "'\"#<>=\\/", "").alias("t"))
    line = F.regexp_replace("t", r"\n", " ")
    quotes = F.concat(F.lit('a = 1\nb = """'), "t", F.lit("\nx\"\"\"\nc = r'''"), line, F.lit("'''\nd = 2"))
    ruby = F.concat(F.lit("a = 1\n=begin\n"), "t", F.lit("\n=end\nb = 2"))
    markup = F.concat(F.lit("<a/><!-- "), "t", F.lit(" --><b/>"))
    out = docs.select("doc_id", lex.blank_triple_strings(quotes).alias("python"), lex.strip_ruby_blocks(ruby).alias("ruby"), lex.strip_markup_comments(markup).alias("markup"))
    return out.select("doc_id", F.md5("python").alias("python_md5"), F.md5("ruby").alias("ruby_md5"), F.md5("markup").alias("markup_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tls_server_hello": _hellos, "tls_handshake": _handshakes, "cipher_suites": _suites, "ssh_keys": _ssh, "system_scores": _system, "comment_families": _families,
}

SQL: dict[str, str] = {
    "tls_server_hello": "SELECT event_id, CAST(771 AS BIGINT) AS version, repeat('ab', CAST(event_id % 5 AS BIGINT)) AS session_id, CASE WHEN event_id % 16 = 15 THEN 'Unknown(0x1234)' ELSE [" + ", ".join(f"'{n}'" for _, n in p.SUITES) + "][1 + event_id % 16] END AS name, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '43:2' ELSE '43:2,51:1' END AS extensions FROM events",
    "tls_handshake": "SELECT event_id, event_id % 256 AS kind, event_id * 7 AS length FROM events",
    "cipher_suites": "WITH s AS (SELECT unnest([" + ", ".join(f"'{n}'" for _, n in p.SUITES) + """]) AS name) SELECT name, CASE WHEN contains(name, '_WITH_') THEN '1.2' ELSE '1.3' END AS version,
        CASE WHEN NOT contains(name, '_WITH_') THEN 'key_share' WHEN contains(name, 'ECDHE_') THEN 'ECDHE' ELSE 'RSA' END AS key_exchange, CASE WHEN NOT contains(name, '_WITH_') THEN 'certificate' WHEN contains(name, 'ECDSA') THEN 'ECDSA' ELSE 'RSA' END AS authentication,
        CASE WHEN contains(name, 'CHACHA20') THEN 'ChaCha20-Poly1305' ELSE replace(regexp_extract(name, 'AES_[0-9]+_(GCM|CBC)', 0), '_', '-') END AS encryption FROM s""",
    "ssh_keys": "WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{a}', {str(b).lower()}, {bits})" for i, ((k, a, b), bits) in enumerate(zip(p.SSH_TYPES, (None, 0, 256, 384, 521, 256, 448, 761, 256)))).replace("None", "NULL") + ") AS v(i, kind, algorithm, vulnerable, bits)) SELECT p_partkey, kind, algorithm, vulnerable, CAST(coalesce(bits, (128 + p_partkey % 4 * 64) * 8) AS BIGINT) AS bits, 'user@host ' || p_partkey AS comment FROM part JOIN t ON t.i = p_partkey % 9",
    "system_scores": "WITH s AS (SELECT p_brand, CAST(floor(sum([0, 25, 60, 100, 80, 50][1 + p_partkey % 6]) / count(*)) AS BIGINT) AS score FROM part GROUP BY p_brand) SELECT p_brand, score, CASE WHEN score < 40 THEN 'F' WHEN score < 60 THEN 'D' WHEN score < 75 THEN 'C' WHEN score < 90 THEN 'B' ELSE 'A' END AS grade FROM s",
    "comment_families": "WITH d AS (SELECT doc_id, repeat(chr(10), length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) AS n FROM documents) SELECT doc_id, md5('a = 1' || chr(10) || 'b = ' || n || chr(10) || chr(10) || 'c = ' || chr(10) || 'd = 2') AS python_md5, md5('a = 1' || chr(10) || chr(10) || n || chr(10) || chr(10) || 'b = 2') AS ruby_md5, md5('<a/>' || n || '<b/>') AS markup_md5 FROM d",
}
