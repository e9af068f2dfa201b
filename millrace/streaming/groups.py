"""Keyed group buffers as Structured Streaming: rows wait in state until their group is complete, then leave whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def complete_groups(stream: DataFrame, key: str, size: int, value: str, wait_ms: int | None = None) -> DataFrame:
    """One row (key, members, timed_out) when `size` rows of a key have come, and the key is forgotten; rows that come
    later begin a new group. With `wait_ms`, what waits longer leaves incomplete. State is bounded by `size` values a key."""
    kinds = dict(stream.dtypes)

    def take(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        done = []
        if state.hasTimedOut:
            done, held = [(k[0], held, True)], []
        else:
            for f in frames:
                held += [str(v) for v in f[value]]
                while len(held) >= size:
                    done.append((k[0], held[:size], False))
                    held = held[size:]
        if held:
            state.update((held,))
            if wait_ms is not None:
                state.setTimeoutDuration(wait_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=[key, "members", "timed_out"])

    timeout = GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy(key).applyInPandasWithState(take, f"{key} {kinds[key]}, members array<string>, timed_out boolean", "held array<string>", "append", timeout)


def idempotent_sink(path: str):
    """For foreachBatch: each batch in a folder of its own, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
