"""The sliding-window limiter over a stream: the rows of operators.limiter.accepts, as soon as the watermark has passed them."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_lists(spark: SparkSession) -> None:
    """States of several variables and timers need this store; set it before the stream is started."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Limiter(StatefulProcessor):
    """State of a bucket of keys: calls that the watermark has not passed, times of the last accepted calls, and the time of the next look."""

    def __init__(self, limit: int, window_seconds: float) -> None:
        self._limit, self._window = limit, int(window_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "key long, at long, id long")
        self._kept = handle.getListState("kept", "key long, at long")
        self._next = handle.getValueState("next", "ms long")

    def _look_at(self, earliest: int) -> None:
        """One timer a bucket: an earlier call moves it forward."""
        ms, held = -(-earliest // 1000), self._next.get() if self._next.exists() else None
        if held is not None and held[0] <= ms:
            return
        if held is not None:
            self._handle.deleteTimer(held[0])
        self._handle.registerTimer(ms)
        self._next.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest, passed = None, timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            at = part["ts"].astype("datetime64[us]").astype("int64")
            kept = part["call"] & (at > passed)
            part, at = part[kept], at[kept]
            if len(part):
                self._waiting.appendList(list(zip(part["key"].tolist(), at.tolist(), part["id"].tolist())))
                earliest = int(at.min()) if earliest is None else min(earliest, int(at.min()))
        if earliest is not None:
            self._look_at(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [(r[0], r[1], r[2]) for r in self._waiting.get()]
        ready, rest = sorted(r for r in waiting if r[1] <= passed), [r for r in waiting if r[1] > passed]
        times: dict[int, deque[int]] = {}
        for of, at in sorted((r[0], r[1]) for r in self._kept.get()):
            times.setdefault(of, deque()).append(at)
        accepted = []
        for of, at, _ in ready:
            held = times.setdefault(of, deque())
            while held and held[0] < at - self._window:
                held.popleft()
            accepted.append(len(held) < self._limit)
            if accepted[-1]:
                held.append(at)
        self._next.clear()
        self._put(self._waiting, rest)
        # The next call is later than the watermark, so times that left its window can go.
        kept = [(of, at) for of, held in times.items() for at in held if at >= passed - self._window]
        self._put(self._kept, kept)
        if rest:
            self._look_at(min(r[1] for r in rest))
        elif kept:
            self._look_at(max(at for _, at in kept) + self._window + 1000)
        if ready:
            keys, at, ids = zip(*ready)
            yield pd.DataFrame({"key": pd.array([None] * len(ready) if key[0] == NO_KEY else keys, "Int64"), "id": ids, "t": [a / 1e6 for a in at], "accepted": accepted})

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


#: Bucket of the calls without a key.
NO_KEY = -1


def accepts_stream(calls: DataFrame, limit: int, window_seconds: float, late: str, buckets: int = 1024) -> DataFrame:
    """(key, id, t, accepted) for a stream of calls (key long, id long, ts timestamp), in append mode.

    A call is judged once the watermark has passed it, so calls that come up to `late` out of order
    are judged in the order of (ts, id) as in a batch; those at or below the watermark of their
    micro-batch are dropped. A row with a null id is
    no call and only moves the watermark (the heartbeat of an idle source). What is held of a key is its
    calls above the watermark and at most `limit` accepted times, and nothing once they have left the window.

    Keys share the state of a bucket, as each look at a state costs far more than the few calls of a key; a task
    holds the calls of one bucket at a time. Null keys are a bucket and a key of their own.
    """
    bucket = F.when(F.col("key").isNull(), F.lit(NO_KEY)).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets))).cast("int")
    no = F.lit(0).cast("long")  # nulls would turn numbers into floats on their way to pandas
    rows = calls.select(bucket.alias("bucket"), F.coalesce("key", no).alias("key"), F.coalesce("id", no).alias("id"), F.col("id").isNotNull().alias("call"), "ts").withWatermark("ts", late)
    return rows.groupBy("bucket").transformWithStateInPandas(_Limiter(limit, window_seconds), "key long, id long, t double, accepted boolean", "Append", "EventTime")
