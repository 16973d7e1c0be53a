"""Sliding-window rate limiter: a call is accepted while fewer than `limit` accepted calls lie in the trailing window; rejected calls leave no trace."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def accepts(calls: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """(key, id, t, accepted) for calls (key, id, t in seconds), in the order of (t, id) of each key.

    Keys are streamed one after the other in sorted partitions: what is held is the accepted times
    of one key's window, at most `limit`, however many calls a key has. An entry exactly
    window_seconds old still counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept, first = None, deque(), True
        for batch in batches:
            out = []
            for key, t in zip(batch.column("key").to_pylist(), batch.column("t").to_pylist()):
                if key != held or first:
                    held, kept, first = key, deque(), False
                while kept and kept[0] < t - window_seconds:
                    kept.popleft()
                out.append(len(kept) < limit)
                if out[-1]:
                    kept.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=["key", "id", "t", "accepted"])

    rows = calls.select("key", "id", "t").repartition("key").sortWithinPartitions("key", "t", "id")
    return rows.mapInArrow(run, "key long, id long, t double, accepted boolean")
