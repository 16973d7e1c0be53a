"""Merkle manifest of a dataset: DuckDB hashes aligned blocks of nodes inside tasks, Spark deals the blocks and joins the proofs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cipherlake.llm.common import discard, released, staged

#: Children of a node.
ARITY = 3
#: Rows that a task hands to DuckDB at a time, whole blocks only.
ROWS = 20_000
PATH = "array<struct<l: binary, r: binary>>"


def leaf_digest(*columns: Column) -> Column:
    """Lowercase hex sha256 of the columns one after the other, each `-` if null, else its UTF-8 byte count, `:` and its value."""
    parts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts)), 256)


def level_queries(levels: int) -> tuple[list[str], str]:
    """DuckDB statements over n0(i, b, p, h, steps): nodes p of block b, of which `steps` levels are to be hashed.

    The first build the level tables n1 ... and, for each level, the members of each run; the last
    gives for each node of n0 its path (l and r: siblings to its left and right, level by level) and the block's root.
    """
    make, cells = [], []
    for k in range(levels):
        members = ", ".join(f"coalesce(max(h) FILTER (p % {ARITY} = {j}), '') AS h{j}" for j in range(ARITY))
        make.append(f"CREATE OR REPLACE TEMP TABLE t{k} AS SELECT b, p // {ARITY} AS q, {members} FROM n{k} WHERE steps > {k} GROUP BY ALL")
        make.append(f"CREATE OR REPLACE TEMP TABLE n{k + 1} AS SELECT b, p // {ARITY} AS p, any_value(steps) AS steps, CASE WHEN any_value(steps) > {k} THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h FROM n{k} GROUP BY b, p // {ARITY}")
        digit = f"(n0.p // {ARITY**k}) % {ARITY}"
        left = f"CASE {digit} " + " ".join(f"WHEN {j} THEN {' || '.join(f't{k}.h{i}' for i in range(j)) or repr('')}" for j in range(ARITY)) + " END"
        right = f"CASE {digit} " + " ".join(f"WHEN {j} THEN {' || '.join(f't{k}.h{i}' for i in range(j + 1, ARITY)) or repr('')}" for j in range(ARITY)) + " END"
        cells.append(f"{{'l': unhex({left}), 'r': unhex({right})}}")
    joins = " ".join(f"LEFT JOIN t{k} ON t{k}.b = n0.b AND t{k}.q = n0.p // {ARITY ** (k + 1)}" for k in range(levels))
    return make, f"SELECT n0.i, ([{', '.join(cells)}])[1:n0.steps] AS path, n{levels}.h AS top FROM n0 {joins} JOIN n{levels} ON n{levels}.b = n0.b ORDER BY n0.i"


def _whole_blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of at least `least` rows of a stream sorted by (tree, block) that cut no block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if sum(b.num_rows for b in held) >= least:
            last, now = held[-1], batch
            key = (last.column("tree")[-1], last.column("block")[-1])
            at = 0
            while at < now.num_rows and (now.column("tree")[at], now.column("block")[at]) == key:
                at += 1
            if at < now.num_rows:
                if at:
                    held.append(now.slice(0, at))
                yield pa.Table.from_batches(held)
                held, batch = [], now.slice(at)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def hash_blocks(nodes: DataFrame, levels: int, rows: int = ROWS) -> DataFrame:
    """The nodes (tree, block, p, h, steps, ...) with path and top in place of steps; a block holds at most ARITY**levels of them.

    Blocks are dealt by key, sorted, and hashed in DuckDB through Arrow; top is the block's root, on the block's first node only.
    """
    make, ask = level_queries(levels)
    fields = [f for f in nodes.schema if f.name != "steps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        try:
            for t in _whole_blocks(batches, rows):
                t = t.combine_chunks()
                code, block = np.asarray(t.column("tree").combine_chunks().dictionary_encode().indices), np.asarray(t.column("block"))
                b = np.concatenate([[0], np.cumsum((code[1:] != code[:-1]) | (block[1:] != block[:-1]))])
                db.register("given", pa.table({"i": np.arange(t.num_rows), "b": b, "p": t.column("p"), "h": t.column("h"), "steps": t.column("steps")}))
                db.execute("CREATE OR REPLACE TEMP TABLE n0 AS SELECT * FROM given")
                db.unregister("given")
                for sql in make:
                    db.execute(sql)
                found = db.execute(ask).to_arrow_table()
                top = pc.if_else(pc.equal(t.column("p"), 0), found.column("top").cast(pa.string()), pa.scalar(None, pa.string()))
                out = pa.table({f.name: t.column(f.name) for f in fields} | {"path": found.column("path").cast(pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))), "top": top})
                yield from out.to_batches(max_chunksize=rows)
        finally:
            db.close()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "p").mapInArrow(released(run), f"{kinds}, path {PATH}, top string")


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows with pos, their place from 0 inside their tree in the given order, and n, the tree's rows; no tree is gathered in one task.

    Rows are range-partitioned and sorted by (tree, order); a partition numbers its own, and the sums of partitions give the
    offsets. The rows must be read from files: a second evaluation must give the same rows. Order columns must leave no ties.
    """
    names, schema = rows.columns, rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(tree).dictionary_encode()
            code = np.asarray(coded.indices)
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            at = np.empty(len(code), np.int64)
            for a, b in zip(cuts, cuts[1:]):
                now = coded.dictionary[int(code[a])].as_py()
                n = n if now == last else 0
                at[a:b] = np.arange(n, n + b - a)
                last, n = now, n + b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, np.int64)), pa.array(at)], names=[*names, "part", "at"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    put = staged(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).mapInArrow(run, f"{kinds}, part long, at long"), "numbered")
    per = put.groupBy(tree, "part").agg(F.count("*").alias("c"))
    w = W.partitionBy(tree)
    before = F.sum("c").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")
    per = per.select(tree, "part", before.alias("before"), F.sum("c").over(w).alias("n"))
    return put.join(per, [tree, "part"]).select(*names, (F.col("before") + F.col("at")).alias("pos"), "n")


def _depth(n: Column) -> Column:
    """Levels until n nodes are one: the powers of ARITY below n."""
    return F.size(F.filter(F.array(*(F.lit(ARITY**i).cast("long") for i in range(39))), lambda p: p < n))


def climb(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Hashes nodes (tree, pos, n, h, ...) up to the roots of their trees: the staged rounds, and (tree, top).

    Each round hashes aligned blocks of ARITY**levels nodes: a tree of one block to its end, others by `levels` levels; the
    blocks' roots are the nodes of the next round. In the last round each tree is one block.
    """
    size, rounds = ARITY**levels, []
    while True:
        steps = F.when(F.col("n") <= size, _depth(F.col("n"))).otherwise(levels).cast("int")
        rest = [c for c in nodes.columns if c not in ("pos", "n", "tree", "h")]
        now = nodes.select("tree", F.floor(F.col("pos") / size).cast("long").alias("block"), F.pmod("pos", F.lit(size)).cast("long").alias("p"), "h", *rest, steps.alias("steps"))
        rounds.append(staged(hash_blocks(now, levels), "blocks"))
        tops = rounds[-1].where("top IS NOT NULL").select("tree", F.col("block").alias("pos"), F.col("top").alias("h"))
        # Block numbers are places already: they only need counting.
        nodes = tops.join(tops.groupBy("tree").agg(F.count("*").alias("n")), "tree")
        if nodes.where("n > 1").isEmpty():
            return rounds, tops.select("tree", F.col("h").alias("top"))


def full_paths(rounds: list[DataFrame], levels: int, above: DataFrame) -> DataFrame:
    """The first round's rows with whole paths, put together from the top downwards; above holds (tree, path, ...) beyond each tree's root."""
    rest = [c for c in above.columns if c not in ("tree", "path")]
    above = above.withColumn("block", F.lit(0).cast("long"))
    for i, hashed in reversed(list(enumerate(rounds))):
        kept = hashed.drop("block", "p", "path", "top").columns if i == 0 else ["tree"]
        below = hashed.join(above.withColumnRenamed("path", "beyond"), ["tree", "block"])
        above = below.select(*kept, (F.col("block") * ARITY**levels + F.col("p")).alias("block"), F.concat("path", "beyond").alias("path"), *rest)
    return above.drop("block")


def _text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def manifest(docs: DataFrame, levels: int = 5) -> DataFrame:
    """For each row of docs (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A source's leaves ascend by doc_id (null first); every three consecutive nodes become their digest until one is left, the
    source's subroot; the subroots by source (null first, UTF-8 bytewise) likewise give the root. The proof is the digest of the
    siblings from the leaf to the root. folded_root folds the proof over the leaf of the text as it is now: in rows whose doc_id
    has an even crc32 its line feeds are taken out (a null doc_id has no crc32 and is not touched).

    Null columns are marked in the leaf, so null and empty texts differ; a lone row's leaf is its subroot, and with one source
    only its subroot is the root. Rows that share a doc_id are ordered by their leaves; whole repeats are leaves of their own. An
    empty table gives no rows; further columns are ignored. `levels` is how many levels one block covers (3**levels leaves) and
    changes no result. A hot source is cut into blocks like any other.
    """
    of = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "n_chars", F.col("text").cast("string").alias("text"))
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    tree = F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("tree")
    leaves = staged(rows.select("doc_id", tree, of(F.col("text")).alias("h"), F.when(hit, of(F.replace("text", F.lit("\n"), F.lit("")))).alias("changed"), F.monotonically_increasing_id().alias("tie")), "leaves")
    inner, tops = climb(numbered(leaves, "tree", "doc_id", "h", "tie").drop("tie"), levels)
    tops = staged(tops.select(F.lit("all").alias("tree"), F.col("tree").alias("of"), F.col("top").alias("h")), "tops")
    outer, root = climb(numbered(tops, "tree", "of"), levels)
    top = root.select(F.col("tree"), F.array().cast(PATH).alias("path"), F.col("top").alias("root"))
    outer = full_paths(outer, levels, top).select(F.col("of").alias("tree"), "path", F.col("h").alias("subroot"), "root")
    out = full_paths(inner, levels, outer)
    folded = F.aggregate("path", F.coalesce("changed", "h"), lambda acc, x: F.sha2(F.concat(_text(x["l"]), acc, _text(x["r"])), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(_text(x["l"]), _text(x["r"]))), ""), 256)
    discard(leaves, tops)
    out = out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
