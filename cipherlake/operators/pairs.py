"""Shortest paths between given pairs of nodes, searched from both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.sources.staging import discard, staged

PAIR = ["start", "finish"]
#: How a node was reached in the last step: from ahead, from back, or as one of the back's own frontier.
_AHEAD, _BACK, _HERE = 1, 2, 4


def pair_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 10) -> DataFrame:
    """(start, finish, depth, path) of the pairs with a path of at most max_depth calls; path is the smallest of the shortest ones, compared node by node.

    edges(caller, callee), pairs(start, finish); repeats count once, a pair of one node has depth 0. Each
    step takes the end whose frontier is smaller one call further. What is kept is, a pair and end, each
    node reached with its smallest path; a pair leaves both frontiers once they have met, so two half searches are
    paid for in place of a whole one. The last step of each end, which reaches most nodes, is kept by neither: see _last.
    Pairs without a path give no row.
    """
    edges = staged(edges.select("caller", "callee").where("caller IS NOT NULL AND callee IS NOT NULL").distinct(), "edges")
    asked = staged(pairs.select(*PAIR).where("start IS NOT NULL AND finish IS NOT NULL").distinct().withColumn("pair", F.monotonically_increasing_id()), "pairs")
    sides = {}
    for side, node in (("ahead", "start"), ("back", "finish")):
        first = staged(asked.select("pair", F.col(node).alias("node"), F.array(node).alias("path")), side)
        sides[side] = {"frontier": first, "reached": [first.select("pair", "node")], "rows": first.count()}
    found, written = [], [edges, sides["ahead"]["frontier"], sides["back"]["frontier"]]
    for depth in range(max_depth + 1):
        ahead, back = sides["ahead"]["frontier"], sides["back"]["frontier"]
        met = ahead.join(back.withColumnRenamed("path", "rest"), ["pair", "node"]).groupBy("pair").agg(F.min(_whole()).alias("path"))
        met = staged(met.withColumn("depth", F.lit(depth).cast("long")), "met")
        found.append(met)
        if depth == max_depth:
            break
        # A pair whose other end can go nowhere has no path either.
        open_ = ahead.select("pair").distinct().join(back.select("pair").distinct(), "pair").join(met, "pair", "left_anti")
        if depth >= max_depth - 2:
            open_ = staged(open_, "open")
            found.append(_last(ahead.join(open_, "pair", "left_semi"), back.join(open_, "pair", "left_semi"), edges, depth, max_depth - depth))
            written.append(open_)
            break
        name = min(sides, key=lambda s: sides[s]["rows"])
        side = sides[name]
        near, far = ("caller", "callee") if name == "ahead" else ("callee", "caller")
        step = side["frontier"].join(open_, "pair", "left_semi").join(edges, F.col("node") == F.col(near)).select("pair", F.col(far).alias("to"), "path")
        path = F.concat("path", F.array("to")) if name == "ahead" else F.concat(F.array("to"), "path")
        ahead_of = step.groupBy("pair", "to").agg(F.min(path).alias("path")).withColumnRenamed("to", "node")
        for seen in side["reached"]:
            ahead_of = ahead_of.join(seen, ["pair", "node"], "left_anti")
        side["frontier"] = staged(ahead_of, name)
        written.append(side["frontier"])
        side["rows"] = side["frontier"].count()
        if not side["rows"]:
            break
        side["reached"].append(side["frontier"].select("pair", "node"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    discard(*written)
    return out.join(asked, "pair").select(*PAIR, "depth", F.array_join("path", ">").alias("path"))


def _whole():
    """path to a node and rest from it, the node once."""
    return F.concat(F.slice("path", 1, F.size("path") - 1), F.col("rest"))


def _last(ahead: DataFrame, back: DataFrame, edges: DataFrame, depth: int, steps: int) -> DataFrame:
    """(pair, path, depth) of the pairs that meet one or two calls after the frontiers (pair, node, path), which have not met.

    The nodes beyond are neither written nor given paths: they are marked by the way they were reached and aggregated once. Paths are put
    together for the nodes with both marks alone, from the frontiers. Nodes met earlier need no exclusion, as a pair that has not met has no shorter path.
    """
    reached = ahead.join(edges, F.col("node") == F.col("caller")).select("pair", F.col("callee").alias("node"), F.lit(_AHEAD).alias("mark"))
    reached = reached.union(back.select("pair", "node", F.lit(_HERE)))
    if steps > 1:
        reached = reached.union(back.join(edges, F.col("node") == F.col("callee")).select("pair", F.col("caller"), F.lit(_BACK)))
    has = lambda marks: F.col("m").bitwiseAND(marks) == marks
    at = F.when(has(_AHEAD | _HERE), depth + 1).when(has(_AHEAD | _BACK), depth + 2)
    marked = staged(reached.groupBy("pair", "node").agg(F.bit_or("mark").alias("m")).select("pair", "node", at.cast("long").alias("depth")).where("depth IS NOT NULL"), "marked")
    hits = marked.join(marked.groupBy("pair").agg(F.min("depth").alias("depth")), ["pair", "depth"])
    to = hits.join(edges.withColumnRenamed("callee", "node"), "node").join(ahead.withColumnRenamed("node", "caller"), ["pair", "caller"])
    to = to.groupBy("pair", "node", "depth").agg(F.min(F.concat("path", F.array("node"))).alias("path"))
    rest = back.withColumnRenamed("path", "rest")
    near = to.where(F.col("depth") == depth + 1).join(rest, ["pair", "node"]).select("pair", "node", "depth", "path", "rest")
    far = to.where(F.col("depth") == depth + 2).join(edges.withColumnRenamed("caller", "node"), "node").join(rest.withColumnRenamed("node", "callee"), ["pair", "callee"])
    whole = near.union(far.select("pair", "node", "depth", "path", F.concat(F.array("node"), "rest").alias("rest")))
    out = staged(whole.groupBy("pair").agg(F.min(_whole()).alias("path"), F.min("depth").alias("depth")), "met")
    discard(marked)
    return out
