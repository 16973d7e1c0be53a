"""Queries of rings, counter mode and residues over `events`, `documents` and `part`; SQL by definition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.functions import modes, residues, rings
from cipherlake.plans import corpus

MODULI = [97, 101, 103, 107, 109]
ODD = [15, 21, 105, 1155]


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, place, coefficient) of the product of two polynomials a user, put together from event ids."""
    e, q = F.col("event_id"), F.lit(rings.Q)
    rows = corpus.table(spark, sf_dir, "events").select("user_id", e, F.lit(0).alias("side")).unionByName(corpus.table(spark, sf_dir, "events").select("user_id", e, F.lit(1).alias("side")))
    rows = rows.select("user_id", "side", F.when(F.col("side") == 0, e % 256).otherwise((e * 5 + 3) % 256).cast("int").alias("place"), F.when(F.col("side") == 0, e % q).otherwise((e * 7 + 1) % q).alias("c"))
    sums = rows.groupBy("user_id", "side", "place").agg((F.sum("c") % q).alias("c"))
    maps = sums.groupBy("user_id").agg(*(F.map_from_entries(F.collect_list(F.when(F.col("side") == s, F.struct("place", "c")))).alias(n) for s, n in ((0, "a"), (1, "b"))))
    dense = lambda n: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at(F.col(n), i), F.lit(0).cast("long")))
    out = maps.select("user_id", dense("a").alias("a"), dense("b").alias("b")).select("user_id", rings.product(F.col("a"), F.col("b")).alias("c"))
    return out.select("user_id", F.posexplode("c").alias("place", "coefficient"))


def _ctr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, bytes, changed, digest) of whole texts that were encrypted and decrypted again under a key and nonce of their own."""
    key, nonce = F.unhex(F.md5(F.encode(F.concat(F.lit("key"), F.col("doc_id").cast("string")), "UTF-8"))), F.unhex(F.lpad(F.hex("doc_id"), 16, "0"))
    rows = corpus.table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"), key.alias("key"), nonce.alias("nonce"))
    rows = rows.withColumn("secret", modes.aes_ctr(F.col("data"), F.col("key"), F.col("nonce")))
    back = modes.aes_ctr(F.col("secret"), F.col("key"), F.col("nonce"))
    return rows.select("doc_id", F.length("secret").cast("long").alias("bytes"), (F.col("secret") != F.col("data")).alias("changed"), F.md5(back).alias("digest"))


def _residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jacobi symbol, a number put together again from five remainders, and the largest power of each part's key."""
    p = F.col("p_partkey")
    x = p * 7919 + F.col("p_size")
    odd = F.get(F.array(*map(F.lit, ODD)), (p % len(ODD)).cast("int"))
    power = residues.perfect_power(p * p)
    return corpus.spread(corpus.table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", residues.jacobi(p, odd).alias("jacobi"), residues.crt(F.array(*(x % m for m in MODULI)), F.array(*map(F.lit, MODULI))).cast("long").alias("joined"), (power["exponent"] >= 2).alias("power"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"ring_products": _products, "ctr_round_trip": _ctr, "residues": _residues}

SQL: dict[str, str] = {
    "ring_products": """WITH a AS (SELECT user_id, event_id % 256 AS place, sum(event_id % 3329) % 3329 AS c FROM events GROUP BY 1, 2), b AS (SELECT user_id, (event_id * 5 + 3) % 256 AS place, sum((event_id * 7 + 1) % 3329) % 3329 AS c FROM events GROUP BY 1, 2),
        s AS (SELECT a.user_id, (a.place + b.place) % 256 AS place, sum(CASE WHEN a.place + b.place < 256 THEN a.c * b.c ELSE -(a.c * b.c) END) AS c FROM a JOIN b ON b.user_id = a.user_id GROUP BY 1, 2),
        u AS (SELECT user_id, unnest(range(0, 256)) AS place FROM (SELECT DISTINCT user_id FROM events))
        SELECT u.user_id, CAST(u.place AS INTEGER) AS place, CAST((coalesce(s.c, 0) % 3329 + 3329) % 3329 AS BIGINT) AS coefficient FROM u LEFT JOIN s ON s.user_id = u.user_id AND s.place = u.place""",
    "ctr_round_trip": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes, coalesce(text, '') <> '' AS changed, md5(coalesce(text, '')) AS digest FROM documents",
    "residues": "WITH l AS (SELECT DISTINCT p_partkey FROM part), s AS (SELECT p_partkey, "
    + ", ".join(f"(SELECT max(CASE WHEN l.p_partkey % {p} = 0 THEN 0 WHEN r * r % {p} = l.p_partkey % {p} THEN 1 ELSE -1 END) FROM (SELECT unnest(range(1, {p})) AS r) t) AS s{p}" for p in (3, 5, 7, 11))
    + f""" FROM l)
        SELECT part.p_partkey, CAST(CASE part.p_partkey % 4 WHEN 0 THEN s3 * s5 WHEN 1 THEN s3 * s7 WHEN 2 THEN s3 * s5 * s7 ELSE s3 * s5 * s7 * s11 END AS INTEGER) AS jacobi, CAST((part.p_partkey * 7919 + p_size) % {97 * 101 * 103 * 107 * 109} AS BIGINT) AS joined, CASE WHEN part.p_partkey >= 2 THEN true END AS power
        FROM part JOIN s ON s.p_partkey = part.p_partkey""",
}
