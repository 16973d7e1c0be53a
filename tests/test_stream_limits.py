"""The limiter over micro-batches against the batch operator."""

import random
from datetime import datetime, timedelta

import pytest

from cipherlake.operators.limiter import accepts
from cipherlake.streaming import limits
from cipherlake.streaming.continuous import run_once

START = datetime(2024, 1, 1)
SCHEMA = "key long, id long, ts timestamp"


def stream(spark, folder, parts):
    """A file a micro-batch, in order of time of change."""
    import os

    for i, rows in enumerate(parts):
        at = f"{folder}/part{i}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(at)
        for name in os.listdir(at):
            os.utime(f"{at}/{name}", (1_700_000_000 + i * 10,) * 2)
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.fixture
def lists(spark):
    limits.use_state_lists(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_out_of_order_batches_give_the_rows_of_the_batch(spark, tmp_path, lists):
    draw = random.Random(5)
    calls = [(draw.randrange(6) or None, i, START + timedelta(seconds=draw.randrange(600))) for i in range(300)]
    shuffled = sorted(calls, key=lambda c: c[2] + timedelta(seconds=draw.randrange(50)))
    parts = [shuffled[i : i + 60] for i in range(0, 300, 60)] + [[(None, None, START + timedelta(days=1))]]
    got = run_once(limits.accepts_stream(stream(spark, tmp_path, parts), 2, 20, "60 seconds"), "append").collect()
    batch = spark.createDataFrame(calls, SCHEMA).selectExpr("key", "id", "CAST(ts AS DOUBLE) AS t")
    want = accepts(batch, 2, 20).collect()
    assert sorted((r.id, r.key, r.t, r.accepted) for r in got) == sorted((r.id, r.key, r.t, r.accepted) for r in want)
    assert {r.accepted for r in got} == {True, False}


def test_late_calls_are_dropped_and_state_leaves(spark, tmp_path, lists):
    at = lambda s: START + timedelta(seconds=s)
    parts = [[(1, 1, at(0)), (1, 2, at(5))], [(1, None, at(500))], [(1, 3, at(3)), (1, 4, at(495))], [(2, None, at(5000))]]
    seen = []
    query = limits.accepts_stream(stream(spark, tmp_path / "in", parts), 1, 60, "10 seconds").writeStream.foreachBatch(lambda rows, _: seen.extend(rows.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.id, r.accepted) for r in sorted(seen, key=lambda r: r.id)] == [(1, True), (2, False), (4, True)]
    states = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: __import__("json").loads(p.json), query.recentProgress) if p["stateOperators"]]
    assert states[-1] == 0 and max(states) > 0
