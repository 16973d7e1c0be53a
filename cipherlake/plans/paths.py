"""Query of paths between pairs of a graph put together from `orders`; SQL walks back from each finish over all nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.operators.pairs import pair_paths
from cipherlake.plans import corpus

DEPTH = 6


def _node(column):
    return F.concat(F.lit("c"), column.cast("string"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call an order between customers' nodes, a pair a supplier."""
    n = corpus.table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    edges = corpus.table(spark, sf_dir, "orders").join(F.broadcast(n)).select(_node(F.col("o_custkey")).alias("caller"), _node((F.col("o_custkey") * 31 + F.col("o_orderkey") * 17) % F.col("n")).alias("callee"))
    pairs = corpus.table(spark, sf_dir, "supplier").join(F.broadcast(n)).select(_node(F.col("s_suppkey") % F.col("n")).alias("start"), _node((F.col("s_suppkey") * 7 + F.col("s_nationkey")) % F.col("n")).alias("finish"))
    return pair_paths(edges, pairs, DEPTH)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"callgraph_pair_paths": _paths}

SQL: dict[str, str] = {
    "callgraph_pair_paths": f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer),
        edges AS (SELECT DISTINCT 'c' || o_custkey AS caller, 'c' || ((o_custkey * 31 + o_orderkey * 17) % n) AS callee FROM orders, n),
        pairs AS (SELECT DISTINCT 'c' || (s_suppkey % n) AS start, 'c' || ((s_suppkey * 7 + s_nationkey) % n) AS finish FROM supplier, n),
        back AS (SELECT DISTINCT finish, finish AS node, CAST(0 AS BIGINT) AS d FROM pairs UNION SELECT b.finish, e.caller, b.d + 1 FROM back b JOIN edges e ON e.callee = b.node WHERE b.d < {DEPTH}),
        dist AS (SELECT finish, node, min(d) AS d FROM back GROUP BY finish, node),
        walk AS (SELECT p.start, p.finish, p.start AS node, d.d AS rest, d.d AS depth, p.start AS path FROM pairs p JOIN dist d ON d.finish = p.finish AND d.node = p.start
          UNION ALL SELECT w.start, w.finish, min(e.callee), w.rest - 1, w.depth, w.path || '>' || min(e.callee) FROM walk w JOIN edges e ON e.caller = w.node JOIN dist d ON d.finish = w.finish AND d.node = e.callee AND d.d = w.rest - 1
            WHERE w.rest > 0 GROUP BY w.start, w.finish, w.rest, w.depth, w.path)
        SELECT start, finish, depth, path FROM walk WHERE rest = 0""",
}
