"""A group buffer with typed list state, timers and time-to-live: whole groups leave with what is known of them.

Rows of a batch are appended to the state of their group in one call and read only when the group leaves, so a batch costs what it brings and
not what waits; a group that one batch makes whole leaves without passing through state. State must be kept by RocksDB (`use_rocksdb`)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

META = "n int, reward_mean double, first_time timestamp, last_time timestamp, timed_out boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that lists and timers ask for; to be set before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class GroupBuffer(StatefulProcessor):
    """Holds the rows of a group until `size` have come or nothing has come for `wait_ms`."""

    def __init__(self, key: str, fields: list[str], held: StructType, size: int, wait_ms: int, reward: str, time: str, ttl_ms: int | None, by_event: bool) -> None:
        self.key, self.fields, self.held, self.size, self.wait_ms, self.reward, self.time, self.ttl_ms, self.by_event = key, fields, held, size, wait_ms, reward, time, ttl_ms, by_event

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.held, self.ttl_ms)
        self.count = handle.getValueState("count", "n int, last_ms bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waited = self.count.exists()
        n, last = self.count.get() if waited else (0, 0)
        fresh: list[tuple] = []
        for frame in rows:
            fresh += [tuple(_plain(v) for v in row) for row in frame[self.fields].itertuples(index=False, name=None)]
            if self.by_event:
                last = max(last, int(frame[self.time].max().timestamp() * 1000))
        n += len(fresh)
        if not self.by_event:
            last = timerValues.getCurrentProcessingTimeInMs()
        if waited:
            self._forget_timers()
        if n >= self.size:
            held = (list(self.rows.get()) if waited else []) + fresh
            if waited:
                self._forget()
            yield self._leaving(key, held, False)
        else:
            self.rows.appendList(fresh)
            self.count.update((n, last))
            self.handle.registerTimer(last + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.rows.exists():
            held = list(self.rows.get())
            self._forget()
            yield self._leaving(key, held, True)

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)

    def _forget(self) -> None:
        self.rows.clear()
        self.count.clear()

    def _leaving(self, key, held: list[tuple], timed_out: bool) -> pd.DataFrame:
        reward, time = self.fields.index(self.reward), self.fields.index(self.time)
        rewards, times = [r[reward] for r in held if r[reward] is not None], [r[time] for r in held if r[time] is not None]
        return pd.DataFrame({
            self.key: [key[0]], "members": [[dict(zip(self.fields, r, strict=True)) for r in held]], "n": [len(held)], "reward_mean": [sum(rewards) / len(rewards) if rewards else None],
            "first_time": [min(times, default=None)], "last_time": [max(times, default=None)], "timed_out": [timed_out],
        })

    def close(self) -> None:
        pass


def _plain(v):
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    if hasattr(v, "item"):
        v = v.item()
    return None if isinstance(v, float) and v != v else v


def buffered_groups(stream: DataFrame, key: str, size: int, wait_ms: int, reward: str = "reward", time: str = "ts", by_event: bool = True, ttl_ms: int | None = None) -> DataFrame:
    """Groups (key, members, and META of each) of `stream`, each once it has `size` rows or more, or, `timed_out`, once nothing has come for
    `wait_ms`: by the watermark of `time`, or by the clock unless `by_event`. A group that left is forgotten; rows that
    come later, if the watermark lets them pass, begin it anew. With `ttl_ms` state that nothing ever called for goes by itself.
    Null rewards and times are left out of what is told of a group."""
    fields = [c for c in stream.columns if c != key]
    held = stream.select(*fields).schema
    out = f"{key} {dict(stream.dtypes)[key]}, members array<{held.simpleString()}>, {META}"
    processor = GroupBuffer(key, fields, held, size, wait_ms, reward, time, ttl_ms, by_event)
    return stream.groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime" if by_event else "ProcessingTime")


def group_meta(groups: DataFrame) -> DataFrame:
    """What is known of a batch of groups: their number, rows, mean size and mean reward, and those that timed out."""
    return groups.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.avg("n").alias("mean_size"), F.try_divide(F.sum(F.col("reward_mean") * F.col("n")), F.sum(F.when(F.col("reward_mean").isNotNull(), F.col("n")))).alias("mean_reward"), F.count_if("timed_out").alias("timed_out"))
