"""Call-graph reachability as level-by-level joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.sources.staging import staged


def shortest_levels(edges: DataFrame, starts: DataFrame, max_depth: int = 10) -> DataFrame:
    """(node, depth) of the nodes within max_depth calls of a start, by breadth-first levels.

    edges(caller, callee) are distinct; each level joins only the frontier, and anti-joins what is
    already reached, so no node is expanded twice however many paths lead to it.
    """
    edges = edges if hasattr(edges, "staged_at") else staged(edges, "edges")
    reached = frontier = staged(starts.select("node").distinct().withColumn("depth", F.lit(0).cast("long")), "level")
    for depth in range(1, max_depth + 1):
        frontier = frontier.join(edges, frontier.node == edges.caller).select(F.col("callee").alias("node")).distinct().join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        frontier = staged(frontier, "level")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def shortest_paths(edges: DataFrame, starts: DataFrame, max_depth: int = 10) -> DataFrame:
    """(node, depth, path) of the nodes within max_depth calls of a start; path is the lexicographically smallest of the shortest ones, joined by >.

    Breadth-first levels as in shortest_levels: the smallest path to a node extends the smallest path
    to a node before it, so a level keeps one path a node whatever the number of paths.
    """
    edges = edges if hasattr(edges, "staged_at") else staged(edges, "edges")
    reached = frontier = staged(starts.select("node").distinct().withColumns({"depth": F.lit(0).cast("long"), "path": F.col("node")}), "level")
    for depth in range(1, max_depth + 1):
        ahead = frontier.join(edges, frontier.node == edges.caller).groupBy(F.col("callee").alias("to")).agg(F.min(F.concat("path", F.lit(">"), "callee")).alias("path"))
        ahead = ahead.join(reached.select("node"), F.col("to") == F.col("node"), "left_anti").select(F.col("to").alias("node"), F.lit(depth).cast("long").alias("depth"), "path")
        frontier = staged(ahead, "level")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def nodes(edges: DataFrame) -> DataFrame:
    """(node, called), distinct by node: whether anything calls it. The edges are read once."""
    end = lambda c, called: F.struct(F.col(c).alias("node"), F.lit(called).alias("called"))
    return edges.select(F.explode(F.array(end("caller", False), end("callee", True))).alias("n")).groupBy("n.node").agg(F.max("n.called").alias("called"))


def entry_points(edges: DataFrame, names: list[str]) -> DataFrame:
    """Nodes that nothing calls, and those with one of the names in theirs."""
    by_name = F.lower("node").rlike("|".join(n.replace(".", "\\.") for n in names))
    return nodes(edges).where(~F.col("called") | by_name).select("node")


def _named(patterns: list[tuple[str, str]]) -> Column:
    return F.coalesce(*(F.when(F.col("node").contains(p), F.lit(a)) for p, a in patterns))


def sinks(edges: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(node, algorithm) of the nodes whose name holds a pattern; the first pattern wins."""
    # What is no sink by its name is left out before the nodes are made distinct.
    ends = edges.select(F.explode(F.array("caller", "callee")).alias("node"))
    return ends.withColumn("algorithm", _named(patterns)).where("algorithm IS NOT NULL").distinct()


def sinks_with_findings(edges: DataFrame, patterns: list[tuple[str, str]], findings: DataFrame) -> DataFrame:
    """(node, algorithm, file, line): sinks by name, and all nodes of a module with a finding of a known algorithm, whose last finding goes before the name.

    findings(module, algorithm, file, line, ord) name the module that they lie in.
    """
    known = sorted({a for _, a in patterns})
    last = findings.where(F.col("algorithm").isin(known)).groupBy("module").agg(F.max_by(F.struct("algorithm", "file", "line"), F.struct("file", "line", "ord")).alias("f"))
    rows = nodes(edges).select("node", F.split("node", "\\.")[0].alias("module"), _named(patterns).alias("named")).join(last, "module", "left")
    return rows.where("f IS NOT NULL OR named IS NOT NULL").select("node", F.coalesce("f.algorithm", "named").alias("algorithm"), "f.file", "f.line")
