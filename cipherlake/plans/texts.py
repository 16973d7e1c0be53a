"""Queries of text attacks, digests and number functions over whole texts; SQL apart from functions.ciphers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.functions import bits, ciphers, lex
from cipherlake.plans import corpus

KEY = [73, 67, 69]


def _english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select("doc_id", ciphers.english_score(F.col("text")).alias("score"))


def _hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of successive items, to the shorter one's length in bytes."""
    b = _bytes_of(corpus.table(spark, sf_dir, "benchmark"), "item_id")
    return b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y")), "item_id").select("item_id", bits.hamming(F.col("x"), F.col("y")).cast("long").alias("bits"))


def _ecb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with two equal whole blocks of 16 bytes."""
    return corpus.table(spark, sf_dir, "documents").select("doc_id", ciphers.repeated_text_blocks(F.col("text")).alias("repeats"))


def _xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts xored with a repeated key: whether that comes back, the bytes' sum, and the bits that differ."""
    b = _bytes_of(corpus.table(spark, sf_dir, "benchmark"), "item_id")
    key = F.array(*map(F.lit, KEY))
    b = b.withColumn("y", bits.xor_cycle(F.col("x"), key))
    total = F.aggregate("y", F.lit(0).cast("long"), lambda s, v: s + v)
    return b.select("item_id", (bits.xor_cycle(F.col("y"), key) == F.col("x")).alias("same"), total.alias("total"), bits.hamming(F.col("x"), F.col("y")).cast("long").alias("weight"))


def _bytes_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, x): the bytes of each text, computed once: the generator keeps later steps from repeating the expression."""
    return rows.select(key, F.explode(F.array(ciphers.text_bytes(F.col("text")))).alias("x"))


def _single_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item xored with a byte of its own; the best key, its score, and the line with the best score of all."""
    b = _bytes_of(corpus.table(spark, sf_dir, "benchmark"), "item_id").withColumn("k", (F.col("item_id") * 37 % 256).cast("int"))
    found = ciphers.best_single_byte(b.select("item_id", F.transform("x", lambda v: v.bitwiseXOR(F.col("k"))).alias("y")), "item_id", "y")
    top = found.agg(F.max(F.struct("score", (-F.col("item_id")).alias("minus"))).alias("t")).select((-F.col("t.minus")).alias("top_item"))
    return found.join(F.broadcast(top), F.lit(True)).select("item_id", F.col("byte").alias("key"), "score", (F.col("item_id") == F.col("top_item")).alias("best_line"))


def _key_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bytes_of(corpus.table(spark, sf_dir, "benchmark"), "item_id").withColumn("sizes", ciphers.key_sizes(F.col("x")))
    return b.select("item_id", F.posexplode("sizes").alias("place", "size")).select("item_id", (F.col("place") + 1).cast("long").alias("place"), F.col("size").cast("long").alias("size"))


def _redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a secret of each kind put in by turn."""
    rows = corpus.table(spark, sf_dir, "conversations")
    secret = F.get(F.array(*(F.lit(x) for x in SECRETS)), (F.col("conv_id") * 3 + F.col("turn")) % len(SECRETS))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), secret, F.lit(" end"))
    return rows.select("conv_id", "turn", F.md5(lex.redact_secrets(text)).alias("redacted_md5"))


#: Secrets that are put into texts, and how each is shown.
SECRETS = ["-----BEGIN RSA PRIVATE KEY-----", "password = 'two words'", 'api_key: "abc def"', "aws_access_key_id='AKIA'", "ghp_" + "a1B2" * 9, "sk-" + "a1B2" * 9, "xoxb-1234567890-abc", "no secret"]
SHOWN = ["[REDACTED-SECRET]"] * 7 + ["no secret"]


def _hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "benchmark").select("item_id", ciphers.hmac_sha256(F.concat(F.lit("key"), F.col("item_id").cast("string")), F.col("text")).alias("hmac"), ciphers.hex_to_base64(F.md5("text")).alias("md5_base64"))


def _merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root of each conversation's turns in order."""
    rows = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tree"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    first = rows.groupBy("tree").agg(F.min("turn").alias("first"))
    return ciphers.merkle_roots(rows.join(first, "tree").select("tree", (F.col("turn") - F.col("first")).alias("pos"), "text"))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = corpus.table(spark, sf_dir, "part"), F.col("p_partkey")
    m = F.lit(1_000_003)
    return p.select("p_partkey", ciphers.gcd(k * 84, F.lit(360)).alias("gcd"), ciphers.power_mod(F.lit(7), k, m.cast("long")).alias("power"), (ciphers.inverse_mod(k, m.cast("long")) * k % m).alias("one"), ciphers.is_prime(k).alias("prime"), ciphers.order_mod(F.lit(2), k % 60 * 2 + 3).cast("long").alias("order"))


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ciphers.factors(corpus.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n")))
    product = F.aggregate("factors", F.lit(1).cast("long"), lambda s, x: s * x)
    return found.select("n", F.array_join(F.transform("factors", lambda x: x.cast("string")), "*").alias("factors"), (product == F.col("n")).alias("whole"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "english_score": _english, "hamming_pairs": _hamming, "ecb_repeat_detect": _ecb, "xor_round_trip": _xor, "single_byte_xor": _single_byte, "key_sizes": _key_sizes,
    "secret_redaction": _redaction, "hmac_sha256": _hmac, "merkle_root": _merkle, "number_functions": _numbers, "factors": _factors,
}

_BYTES = "list_transform(range(0, octet_length(encode(coalesce({0}, '')))), lambda i: CAST('0x' || substr(hex(encode(coalesce({0}, ''))), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
_TEXT = _BYTES.format("text")
_LETTERS = "'" + "".join(ciphers.FREQUENCIES) + "'"
_SHARES = "[" + ", ".join(str(round(1000 * v)) for v in ciphers.FREQUENCIES.values()) + "]"
_ONE = f"CASE WHEN strpos({_LETTERS}, lower(chr(CAST({{0}} AS INTEGER)))) > 0 AND {{0}} BETWEEN 32 AND 126 THEN {_SHARES}[strpos({_LETTERS}, lower(chr(CAST({{0}} AS INTEGER))))] WHEN {{0}} BETWEEN 32 AND 126 THEN 500 ELSE -10000 END"
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
_DIST = " + ".join(f"list_sum(list_transform(list_zip(list_slice(x, s * {i} + 1, s * {i} + s), list_slice(x, s * {j} + 1, s * {j} + s)), lambda p: bit_count(xor(p[1], p[2]))))" for i, j in _PAIRS)


def _merkle_sql(levels: int = 12) -> str:
    out = ["l0 AS (SELECT conv_id AS tree, turn - min(turn) OVER (PARTITION BY conv_id) AS at, sha256(coalesce(text, '')) AS h FROM conversations)"]
    for k in range(1, levels + 1):
        out.append(f"l{k} AS (SELECT a.tree, CAST(floor(a.at / 2) AS BIGINT) AS at, CASE WHEN (SELECT count(*) FROM l{k - 1} c WHERE c.tree = a.tree) = 1 THEN a.h ELSE sha256(unhex(a.h || coalesce(b.h, a.h))) END AS h FROM l{k - 1} a LEFT JOIN l{k - 1} b ON b.tree = a.tree AND b.at = a.at + 1 WHERE a.at % 2 = 0)")
    return "WITH " + ", ".join(out) + f" SELECT tree, h AS root FROM l{levels}"


SQL: dict[str, str] = {
    "english_score": f"WITH b AS (SELECT doc_id, unnest({_TEXT}) AS b FROM documents) SELECT d.doc_id, CAST(coalesce(sum({_ONE.format('b.b')}), 0) AS BIGINT) AS score FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id GROUP BY d.doc_id",
    "hamming_pairs": f"WITH b AS (SELECT item_id, {_TEXT} AS x FROM benchmark) SELECT a.item_id, CAST(list_sum(list_transform(range(1, least(len(a.x), len(c.x)) + 1), lambda i: bit_count(xor(a.x[i], c.x[i])))) AS BIGINT) AS bits FROM b a JOIN b c ON c.item_id = a.item_id + 1",
    "ecb_repeat_detect": "WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), b AS (SELECT doc_id, substr(h, CAST(32 * i + 1 AS BIGINT), 32) AS block FROM (SELECT doc_id, h, unnest(range(0, CAST(floor(length(h) / 32) AS BIGINT))) AS i FROM h)), r AS (SELECT doc_id, count(*) > count(DISTINCT block) AS repeats FROM b GROUP BY doc_id) SELECT d.doc_id, coalesce(r.repeats, false) AS repeats FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id",
    "xor_round_trip": f"WITH b AS (SELECT item_id, {_TEXT} AS x FROM benchmark), y AS (SELECT item_id, x, list_transform(range(1, len(x) + 1), lambda i: xor(x[i], [73, 67, 69][1 + (i - 1) % 3])) AS y FROM b) SELECT item_id, list_transform(range(1, len(y) + 1), lambda i: xor(y[i], [73, 67, 69][1 + (i - 1) % 3])) = x AS same, CAST(list_sum(y) AS BIGINT) AS total, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: bit_count(xor(x[i], y[i])))) AS BIGINT) AS weight FROM y",
    "single_byte_xor": f"""WITH b AS (SELECT item_id, unnest({_TEXT}) AS v, item_id * 37 % 256 AS k FROM benchmark), c AS (SELECT item_id, xor(v, k) AS v, count(*) AS n FROM b GROUP BY ALL),
        s AS (SELECT c.item_id, t.key, sum(n * ({_ONE.format('xor(c.v, t.key)')})) AS score FROM c, (SELECT unnest(range(0, 256)) AS key) t GROUP BY c.item_id, t.key),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, key) AS place FROM s), w AS (SELECT * FROM r WHERE place = 1)
        SELECT item_id, key, CAST(score AS BIGINT) AS score, row_number() OVER (ORDER BY score DESC, item_id) = 1 AS best_line FROM w""",
    "key_sizes": f"""WITH b AS (SELECT item_id, {_TEXT} AS x FROM benchmark), s AS (SELECT item_id, x, unnest(range(2, least(41, CAST(floor(len(x) / 4) AS BIGINT)))) AS s FROM b),
        d AS (SELECT item_id, s AS size, floor(CAST({_DIST} AS DOUBLE) / s * 1000000 + 0.5) AS d FROM s), r AS (SELECT item_id, size, row_number() OVER (PARTITION BY item_id ORDER BY d, size) AS place FROM d)
        SELECT item_id, place, size FROM r WHERE place <= 3""",
    "secret_redaction": "SELECT conv_id, turn, md5(coalesce(text, '') || ' ' || [" + ", ".join(f"'{x}'" for x in SHOWN) + f"][1 + (conv_id * 3 + turn) % {len(SHOWN)}] || ' end') AS redacted_md5 FROM conversations",
    "hmac_sha256": """WITH k AS (SELECT item_id, text, rpad(hex(encode('key' || CAST(item_id AS VARCHAR))), 128, '0') AS k FROM benchmark),
        p AS (SELECT item_id, text, array_to_string(list_transform(range(0, 64), lambda i: printf('%02x', xor(CAST('0x' || substr(k, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT), 54))), '') AS a, array_to_string(list_transform(range(0, 64), lambda i: printf('%02x', xor(CAST('0x' || substr(k, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT), 92))), '') AS b FROM k)
        SELECT item_id, sha256(unhex(b || sha256(unhex(a || hex(encode(text)))))) AS hmac, base64(unhex(md5(text))) AS md5_base64 FROM p""",
    "merkle_root": _merkle_sql(),
    "number_functions": """WITH RECURSIVE o AS (SELECT DISTINCT p_partkey % 60 * 2 + 3 AS m, 1 AS k, 2 % (p_partkey % 60 * 2 + 3) AS x FROM part UNION ALL SELECT m, k + 1, x * 2 % m FROM o WHERE x <> 1 AND k < m),
        ord AS (SELECT m, max(k) FILTER (x = 1) AS ord FROM o GROUP BY m),
        pw AS (SELECT CAST(0 AS BIGINT) AS e, CAST(1 AS BIGINT) AS x UNION ALL SELECT e + 1, x * 7 % 1000003 FROM pw WHERE e < (SELECT max(p_partkey) FROM part)),
        comp AS (SELECT DISTINCT a * b AS n FROM (SELECT unnest(range(2, 200)) AS a) x, (SELECT unnest(range(2, 12000)) AS b) y WHERE a <= b AND a * b <= 20000)
        SELECT p_partkey, gcd(p_partkey * 84, 360) AS gcd, w.x AS power, CASE WHEN p_partkey % 1000003 <> 0 THEN CAST(1 AS BIGINT) END AS one, p_partkey > 1 AND p_partkey NOT IN (SELECT n FROM comp) AS prime, CAST(r.ord AS BIGINT) AS "order"
        FROM part JOIN pw w ON w.e = p_partkey JOIN ord r ON r.m = p_partkey % 60 * 2 + 3""",
    "factors": """WITH comp AS (SELECT DISTINCT a * b AS n FROM (SELECT unnest(range(2, 200)) AS a) x, (SELECT unnest(range(2, 12000)) AS b) y WHERE a <= b AND a * b <= 20000),
        primes AS (SELECT p FROM (SELECT unnest(range(2, 20001)) AS p) x WHERE p NOT IN (SELECT n FROM comp)),
        f AS (SELECT p_partkey AS n, p FROM part JOIN primes ON p_partkey % p = 0 JOIN (SELECT unnest(range(1, 16)) AS e) z ON CASE WHEN pow(p, e) <= p_partkey THEN p_partkey % CAST(pow(p, e) AS BIGINT) = 0 ELSE false END WHERE p_partkey > 0),
        g AS (SELECT n, string_agg(CAST(p AS VARCHAR), '*' ORDER BY p) AS factors FROM f GROUP BY n)
        SELECT p_partkey AS n, CASE WHEN p_partkey > 0 THEN coalesce(g.factors, '') END AS factors, CASE WHEN p_partkey > 0 THEN true END AS whole FROM part LEFT JOIN g ON g.n = p_partkey""",
}
