"""Mixing of overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cipherlake.llm.common import WORD, staged

#: Hash buckets in which a pattern's documents are ordered; only the bucket at the edge is ranked by document.
BUCKETS = 4096
#: Rows of a pattern whose counts are chosen anew where the seeded order misses the pattern's words, and steps of the sums of their sizes.
EDGE, STEPS = 64, 1 << 22


def target_tokens(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, most: float = 2.0) -> dict[str | None, float]:
    """Splits total by weight; no source gets over most times its size, what it can't take is shared out again by weight."""
    out, open_, rest = {}, list(sizes), total
    while open_:
        whole = sum(weights[s] for s in open_)
        share = {s: rest * weights[s] / whole for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = 2) -> list[dict]:
    """Tokens that each pattern gives each of its sources, at most its size for each of `repeats` passes.

    Successive shortest paths: pass e of a pattern costs e a token, so costs are convex in the
    repetition and first passes are used up everywhere they help before second ones. The flow is
    the largest one, and the cheapest among those.
    """
    names = list(quotas)
    n = len(patterns)
    at = {s: 1 + n + i for i, s in enumerate(names)}
    sink = 1 + n + len(names)
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    to, cap, cost = [], [], []

    def edge(u: int, v: int, c: int, w: int) -> int:
        for a, b, x, y in ((u, v, c, w), (v, u, 0, -w)):
            graph[a].append(len(to))
            to.append(b)
            cap.append(x)
            cost.append(y)
        return len(to) - 2

    routes: list[list[tuple]] = []
    for i, (members, size) in enumerate(patterns):
        for e in range(repeats):
            edge(0, 1 + i, size, e)
        routes.append([(s, edge(1 + i, at[s], repeats * size, 0)) for s in members if s in at])
    for s in names:
        edge(at[s], sink, quotas[s], 0)
    height = [0] * (sink + 1)
    while True:
        far, via = [float("inf")] * (sink + 1), [-1] * (sink + 1)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for k in graph[u]:
                if cap[k] > 0 and (x := d + cost[k] + height[u] - height[to[k]]) < far[to[k]]:
                    far[to[k]], via[to[k]] = x, k
                    heapq.heappush(heap, (x, to[k]))
        if far[sink] == float("inf"):
            break
        height = [h + (f if f < float("inf") else far[sink]) for h, f in zip(height, far)]
        path, v = [], sink
        while v:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(cap[k] for k in path)
        for k in path:
            cap[k] -= push
            cap[k ^ 1] += push
    return [{s: cap[k ^ 1] for s, k in r if cap[k ^ 1]} for r in routes]


def nearest_counts(sizes: list[int], usual: int, repeats: int, due: int, steps: int = STEPS) -> list[int]:
    """A count from 0 to repeats for each size so that size * count adds up as near to due as any choice does (ties: to less).

    Sums that can be reached are the bits of a whole number, a size after the other; going back through them, each size takes the
    count nearest to `usual` from which the rest can still be reached. Sums of over `steps` words are counted in larger units.
    """
    unit = max(1, -(-repeats * sum(sizes) // steps))
    units = [max(1, round(s / unit)) for s in sizes]
    reached = [1]
    for u in units:
        now = reached[-1]
        for _ in range(repeats):
            now |= now << u
            now |= reached[-1]
        reached.append(now)
    want, all_sums = max(0, round(due / unit)), reached[-1]
    below = all_sums & ((1 << (want + 1)) - 1)
    down = below.bit_length() - 1
    above = all_sums >> (want + 1)
    up = want + 1 + (above & -above).bit_length() - 1 if above else None
    left = down if up is None or want - down <= up - want else up
    order = sorted(range(repeats + 1), key=lambda c: (abs(c - usual), c))
    out = []
    for u, before in zip(reversed(units), reversed(reached[:-1])):
        c = next(c for c in order if left >= c * u and before >> (left - c * u) & 1)
        out.append(c)
        left -= c * u
    return out[::-1]


def word_count(text: Column) -> Column:
    """Words of a whole text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Up to so many patterns the plan's one row a pattern is broadcast, beyond it is joined by shuffles, with the same result.
BROADCAST_ROWS = 10_000


def mix_sources(docs: DataFrame, share: float = 1.5, cycle: tuple[float, ...] = (3.0, 1.0, 2.0), repeats: int = 2, seed: int = 17, size: Column | None = None, members: Column | None = None, broadcast_rows: int = BROADCAST_ROWS, edge_rows: int = EDGE) -> DataFrame:
    """A row for each row of docs (doc_id, text, source, ...): doc_id, source, size, source_size, target, taken, times, h (its seeded hash).

    size is the number of words (or the given column); members the array of sources that a row
    belongs to (its source alone by default; null is a source of its own, last in order, and so is
    an empty array's). Sources in code point order have the weights of the cycle in turn; their
    targets are target_tokens of `share` times all sizes, at most `repeats` times a source's size.
    Rows with equal members form a pattern; the flow says how many tokens each pattern gives. Every
    full pass takes each row of the pattern once more; the rest of the last pass goes to rows in the
    order of a seeded hash of doc_id and text: each row is taken that fits what is still open, and
    one that doesn't is passed over, so in the end no row left fits. Where words are still open then, the counts of the pattern's
    first `edge_rows` rows in that order (all rows of a small pattern) are chosen anew, from 0 to `repeats`, for the nearest sum (edge_rows 0: left as they are). taken = size * times; no row
    exceeds repeats * size. source_size and target are those of the row's first member.

    The driver holds one row a pattern and round, not a document; a round ends at a row that is
    passed over. Rows of a hot pattern are ordered by hash buckets, and ranked one by one only
    inside the one bucket where the round ends. Empty and null
    texts have size 0 and are never taken. Repeated rows are rows of their own. Reruns agree. An
    empty table gives no rows; further columns are ignored.
    """
    out = _mix(docs, False, share, cycle, repeats, seed, size, members, broadcast_rows, edge_rows)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "h")


def _mix(docs: DataFrame, carry: bool, share: float = 1.5, cycle: tuple[float, ...] = (3.0, 1.0, 2.0), repeats: int = 2, seed: int = 17, size: Column | None = None, members: Column | None = None, broadcast_rows: int = BROADCAST_ROWS, edge_rows: int = EDGE) -> DataFrame:
    """The rows of mix_sources; with carry each also holds the whole row of docs, as the struct `row`."""
    members = members if members is not None else F.array("source")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), members.cast("array<string>").alias("members"), (size if size is not None else word_count(F.col("text"))).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text")).alias("h"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []),
    )
    one_null = F.array(F.lit(None).cast("string"))
    rows = rows.withColumn("members", F.when(F.size("members") > 0, F.array_sort(F.array_distinct("members"))).otherwise(one_null)).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    rows = staged(rows.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    groups = [(tuple(r.members), int(r.size)) for r in rows.groupBy("members").agg(F.sum("size").alias("size")).collect()]
    order = lambda s: (s is None, s or "")
    groups.sort(key=lambda g: [order(s) for s in g[0]])
    sizes: dict[str | None, int] = {}
    for names, n in groups:
        for s in names:
            sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=order)
    weights = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    whole = share * sum(n for _, n in groups)
    targets = target_tokens(sizes, weights, whole, float(repeats))
    flows = min_cost_flow(groups, {s: round(t) for s, t in targets.items()}, repeats)
    plan = [(list(g), *(divmod(sum(f.values()), n) if n else (0, 0)), n, sizes[g[0]], float(targets[g[0]])) for (g, n), f in zip(groups, flows)]
    spark = docs.sparkSession
    table = spark.createDataFrame(plan, "members array<string>, passes long, rest long, pattern_size long, source_size long, target double")
    key = F.to_json(F.struct("members"), {"ignoreNullFields": "false"})
    small = (lambda df: F.broadcast(df)) if len(plan) <= broadcast_rows else (lambda df: df)
    table, rows = table.withColumn("pattern", key).drop("members"), rows.withColumn("pattern", key).withColumn("at", F.struct("bucket", "h", "doc_id", "rid"))
    # The last pass in rounds: of the rows behind the last cut that fit the gap, all up to the first that fits no more are taken; it is the next cut.
    at_type = "struct<bucket: long, h: long, doc_id: long, rid: long>"
    open_ = {r.pattern: (r.rest, None) for r in table.where("rest > 0").collect()}
    rounds: list[tuple] = []
    while open_:
        now = spark.createDataFrame([(p, gap, cut) for p, (gap, cut) in open_.items()], f"pattern string, gap long, cut {at_type}")
        left = rows.join(small(now), "pattern").where("size > 0 AND size <= gap AND (cut IS NULL OR at > cut)").select("pattern", "bucket", "at", "size", "gap")
        w = W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        per = left.groupBy("pattern", "bucket", "gap").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        edge = per.where("before <= gap AND before + n > gap").select("pattern", "bucket", "before")
        inside = left.join(small(edge), ["pattern", "bucket"]).withColumn("upto", F.col("before") + F.sum("size").over(W.partitionBy("pattern").orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
        ends = {r.pattern: r.x for r in inside.where("upto > gap").groupBy("pattern").agg(F.min(F.struct("at", (F.col("upto") - F.col("size")).alias("used"))).alias("x")).collect()}
        rounds += [(p, gap, tuple(ends[p]["at"]) if p in ends else None) for p, (gap, _) in open_.items()]
        open_ = {p: (open_[p][0] - x.used, tuple(x["at"])) for p, x in ends.items() if open_[p][0] > x.used}
    # Gaps only shrink and cuts only move on: a row is taken if it lies before the cut of a round whose gap it fits.
    ended = spark.createDataFrame(rounds, f"pattern string, gap long, cut {at_type}").groupBy("pattern").agg(F.collect_list(F.struct("gap", "cut")).alias("rounds"))
    fits = F.exists("rounds", lambda r: (F.col("size") <= r["gap"]) & (r["cut"].isNull() | (F.col("at") < r["cut"])))
    out = rows.join(small(table), "pattern").join(small(ended), "pattern", "left").withColumn("extra", F.coalesce(fits, F.lit(False)).cast("long"))
    out = out.withColumn("times", F.when(F.col("size") > 0, F.col("passes") + F.col("extra")).otherwise(F.lit(0).cast("long")))
    again = staged(_edges(out, small(table.select("pattern", (F.col("passes") * F.col("pattern_size") + F.col("rest")).alias("due"))), repeats, edge_rows), "edges").withColumnRenamed("times", "chosen")
    out = out.join(F.broadcast(again) if len(plan) * edge_rows <= broadcast_rows else again, "rid", "left").withColumn("times", F.coalesce("chosen", "times"))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", "h", *(["row"] if carry else []))


def _edges(out: DataFrame, due: DataFrame, repeats: int, edge: int) -> DataFrame:
    """(rid, times): the counts of the first `edge` rows of each pattern whose rows don't take just what is due, chosen by nearest_counts."""
    w = W.partitionBy("pattern")
    per = out.groupBy("pattern", "bucket").agg(F.sum((F.col("size") > 0).cast("long")).alias("c"), F.sum(F.col("size") * F.col("times")).alias("t"))
    per = per.select("pattern", "bucket", (F.sum("c").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).alias("before"), F.sum("t").over(w).alias("got"))
    open_ = per.where(F.col("before") < edge).join(due, "pattern").where("got <> due").select("pattern", "bucket", (F.col("due") - F.col("got")).alias("open"))
    some = out.where("size > 0").select("pattern", "bucket", "at", "rid", "size", "times", "passes").join(open_, ["pattern", "bucket"])
    some = some.withColumn("rank", F.row_number().over(w.orderBy("at"))).where(F.col("rank") <= edge).drop("at", "bucket")

    def choose(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("rank")
        total = int(t["open"].iloc[0] + (t["size"] * t["times"]).sum())
        return pd.DataFrame({"rid": t["rid"], "times": nearest_counts(t["size"].tolist(), int(t["passes"].iloc[0]), repeats, total)})

    return some.groupBy("pattern").applyInPandas(choose, "rid long, times long")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns: the words written are those of mix_sources.

    Each row carries its own columns through the mix, so rows that repeat a document are taken each
    by its own count. Rows with null or empty texts are never taken; a null doc_id or source is a
    value like others; an empty table stays empty.
    """
    out = _mix(docs, True, **options).where("times > 0").withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long"))))
    return out.select("row.*")
