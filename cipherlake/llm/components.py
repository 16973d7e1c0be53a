"""Connected components by alternating large-star and small-star steps, with no edge on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.common import discard, staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge; component is the smallest node reachable.

    Each round hangs every node below the smallest of its neighbours (first the larger
    neighbours, then the smaller ones) until each component is a star. The minimum of a node is
    aggregated before the shuffle, so a node with very many neighbours is no hot key there; the
    join that follows is one that adaptive execution can split. Edges with a null end and loops
    are ignored; repeated edges count once; no edges give no rows.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour v of u goes below u's minimum m.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours v of u, and u itself, go below the smallest of them.
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(under, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = staged(small, "cc")
        same = after.join(edges, ["u", "v"], "left_semi").count()
        done = same == after.count() == edges.count()
        discard(edges)
        edges = after
        if done:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
