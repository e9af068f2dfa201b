"""Rollouts as streams: taking whole groups with carry-over, chunked answers, spans, committed metrics and sessions.

What a batch writes goes to a folder of its own and depends only on the batch and on what the batch before it wrote, so
a batch that is run again replaces itself."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.trajectories import TURN, built_rows, session_rows, turn_columns


def take_groups(path: str, group: str, arrival: str, target: int, status: str | None = None):
    """For foreachBatch: each batch takes `target` whole groups, the longest waiting first (`first_batch` says since
    when), and leaves the rest in `carry` for the next. Groups with an aborted row go to `requeue`, whose rows may be
    sent again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = batch.withColumn("first_batch", F.lit(batch_id).cast("bigint"))
        if batch_id > 0:
            rows = spark.read.schema(rows.schema).parquet(f"{path}/carry/batch={batch_id - 1}").unionByName(rows)
        aborted = F.bool_or(F.coalesce(F.col(status) == "aborted", F.lit(False))) if status else F.lit(False)
        groups = rows.groupBy(group).agg(F.min("first_batch").alias("__since"), F.min(arrival).alias("__arrival"), aborted.alias("__aborted"))
        taken = groups.filter(~F.col("__aborted")).orderBy("__since", "__arrival", group).limit(target).select(F.col(group).alias("__taken"))
        marked = rows.join(groups.select(F.col(group).alias("__group"), "__aborted"), F.col(group).eqNullSafe(F.col("__group"))).join(taken.withColumn("__ok", F.lit(True)), F.col(group).eqNullSafe(F.col("__taken")), "left")
        place = F.when(F.col("__aborted"), "requeue").when(F.col("__ok"), "taken").otherwise("carry")
        marked = marked.select(*rows.columns, place.alias("__place")).persist()
        for name in ("taken", "requeue", "carry"):
            marked.filter(F.col("__place") == name).drop("__place").write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        marked.unpersist()

    return write


def leaving_groups(path: str, key: str, done: Column, leave: Callable[[DataFrame], DataFrame]):
    """For foreachBatch: rows wait in `carry` until `done`, an aggregate over all rows of their key, holds; then the key leaves. `leave`
    makes of one row a key (key, `rows` as an array of structs) what goes to `out`. For streams without timers: keys are
    grouped and read as a whole, where a state operator calls Python for each of them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = batch
        if batch_id > 0:
            held = f"{key} {dict(batch.dtypes)[key]}, rows array<{batch.schema.simpleString()}>"
            rows = spark.read.schema(held).parquet(f"{path}/groups/batch={batch_id - 1}/done=false").select(F.inline("rows")).unionByName(rows)
        groups = rows.groupBy(key).agg(F.collect_list(F.struct(*batch.columns)).alias("rows"), F.coalesce(done, F.lit(False)).alias("done"))
        # Both folders exist, even if no key goes there.
        none = spark.createDataFrame([(False,), (True,)], "done boolean").select(F.lit(None).cast(dict(batch.dtypes)[key]).alias(key), F.lit(None).cast(f"array<{batch.schema.simpleString()}>").alias("rows"), "done")
        groups.unionByName(none).write.mode("overwrite").partitionBy("done").parquet(f"{path}/groups/batch={batch_id}")
        whole = spark.read.schema(f"{key} {dict(batch.dtypes)[key]}, rows array<{batch.schema.simpleString()}>").parquet(f"{path}/groups/batch={batch_id}/done=true")
        leave(whole.filter("rows is not null")).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    return write


def whole_answers(path: str, key: str = "request_id"):
    """For foreachBatch: chunks (key, seq, text, metadata as a map, finish_reason) become one row an answer, as by `folded_chunks`, once the last and
    all before it have come."""

    def fold(groups: DataFrame) -> DataFrame:
        parts = F.transform("rows", lambda r: F.struct(r["seq"].alias("seq"), F.coalesce(r["text"], F.lit("")).alias("text"), F.map_entries(r["metadata"]).alias("metadata"), r["finish_reason"].alias("finish_reason")))
        g = groups.select(key, F.array_sort(parts).alias("c"))
        entries = F.flatten(F.transform("c", lambda c: F.coalesce(c["metadata"], F.expr("array()"))))
        g = g.withColumn("e", F.reverse(entries)).withColumn("k", F.transform("e", lambda e: e["key"]))
        last = F.map_from_entries(F.filter("e", lambda e, i: F.array_position("k", e["key"]) == i + 1))  # the first from the end
        reason = F.get(F.filter("c", lambda c: c["finish_reason"].isNotNull()), F.lit(0))["finish_reason"]
        return g.select(key, F.array_join(F.transform("c", lambda c: c["text"]), "").alias("text"), last.alias("metadata"), reason.alias("finish_reason"), F.size("c").alias("chunks"))

    return leaving_groups(path, key, F.count("*") > F.min(F.when(F.col("finish_reason").isNotNull(), F.col("seq"))), fold)


def ended_sessions(path: str, session: str, number: str, ended: str, threshold: int = 1024):
    """For foreachBatch: the training rows of each session, as by `finished_sessions`, once one of its turns says that it has ended."""

    def leave(groups: DataFrame) -> DataFrame:
        turns = groups.select(session, F.transform("rows", lambda r: F.struct(r[number].alias("number"), *turn_columns(r))).alias("turns"))
        return built_rows(turns, session, threshold).select(session, "row", "tokens", "response_length", "loss_mask")

    return leaving_groups(path, session, F.bool_or(F.coalesce(F.col(ended), F.lit(False))), leave)


def waiting(wait_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def folded_chunks(stream: DataFrame, key: str = "request_id", wait_ms: int | None = None) -> DataFrame:
    """Chunks (key, seq, text, metadata as a map, finish_reason) of one answer become one row when the last has come: texts
    in order of seq, metadata merged with later chunks winning. State is one answer a key, and is dropped then; with `wait_ms`
    an answer to which nothing has come for so long leaves as it is, its reason `timeout`."""
    kind = dict(stream.dtypes)[key]

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [json.loads(x) for x in state.get[0]] if state.exists else []
        for f in frames:
            held += [[int(r.seq), r.text or "", dict(r.metadata) if r.metadata is not None else {}, r.finish_reason] for r in f.itertuples()]
        held.sort(key=lambda c: c[0])
        last = next((c for c in held if c[3] is not None), None)
        if state.hasTimedOut:
            last = [0, "", {}, "timeout"]
        elif last is None or len(held) <= last[0]:  # chunks are counted from 0
            state.update(([json.dumps(c) for c in held],))
            if wait_ms is not None:
                state.setTimeoutDuration(wait_ms)
            return
        if state.exists:
            state.remove()
        merged: dict[str, str] = {}
        for c in held:
            merged |= c[2]
        yield pd.DataFrame({key: [k[0]], "text": ["".join(c[1] for c in held)], "metadata": [merged], "finish_reason": [last[3]], "chunks": [len(held)]})

    out = f"{key} {kind}, text string, metadata map<string,string>, finish_reason string, chunks int"
    return stream.groupBy(key).applyInPandasWithState(fold, out, "held array<string>", "append", waiting(wait_ms))


def joined_spans(starts: DataFrame, ends: DataFrame, key: str, late: str = "10 minutes", longest: str = "1 hour") -> DataFrame:
    """Starts and ends (key, ts) of spans; both sides forget what is older than the watermark and the longest span."""
    a = starts.withWatermark("ts", late).select(F.col(key), F.col("ts").alias("start_ts"))
    b = ends.withWatermark("ts", late).select(F.col(key).alias("__key"), F.col("ts").alias("end_ts"))
    within = (F.col("end_ts") >= F.col("start_ts")) & (F.col("end_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {longest}"))
    return a.join(b, (F.col(key) == F.col("__key")) & within).select(key, "start_ts", "end_ts", (F.unix_micros("end_ts") - F.unix_micros("start_ts")).alias("micros"))


def committed_sink(path: str):
    """For foreachBatch: rows first, then the mark that they count."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        batch.sparkSession.range(1).select(F.lit(batch_id).cast("int").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/at={batch_id}")

    return write


def committed_rows(spark: SparkSession, path: str, committed: bool = True) -> DataFrame:
    """The rows of batches with a mark, or of those without one."""
    marks = spark.read.parquet(f"{path}/commits").select("batch").distinct()
    return spark.read.parquet(f"{path}/rows").join(F.broadcast(marks), "batch", "left_semi" if committed else "left_anti")  # one small row a batch


def archive_uncommitted(spark: SparkSession, path: str, name: str) -> int:
    """Copies the rows that no mark covers to `archive/name` and says how many they are; readers never count them."""
    committed_rows(spark, path, committed=False).write.mode("overwrite").parquet(f"{path}/archive/{name}")
    return spark.read.parquet(f"{path}/archive/{name}").count()


def finished_sessions(stream: DataFrame, session: str, number: str, ended: str, threshold: int = 1024, wait_ms: int | None = None) -> DataFrame:
    """Turns by session wait in state until one says that the session has ended; then its training rows leave. With `wait_ms`
    a session to which nothing has come for so long leaves with the turns it has."""
    names = [c.split()[0] for c in TURN.split(", ")]
    kind = dict(stream.dtypes)[session]

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if hasattr(v, "tolist"):
            v = v.tolist()
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    def build(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        over = state.hasTimedOut
        for f in frames:
            for r in f.to_dict("records"):
                turn = {n: plain(r[n]) for n in names}
                for n in ("prompt", "prompt_ids", "output_ids", "logprobs"):
                    turn[n] = turn[n] or []
                held.append(json.dumps([int(r[number]), turn]))
                over = over or bool(r[ended])
        if not over:
            state.update((held,))
            if wait_ms is not None:
                state.setTimeoutDuration(wait_ms)
            return
        if state.exists:
            state.remove()
        turns = sorted((json.loads(x) for x in held), key=lambda x: x[0])
        rows = session_rows([t for _, t in turns], threshold)
        yield pd.DataFrame([(k[0], r["row"], r["tokens"], r["response_length"], r["loss_mask"]) for r in rows], columns=[session, "row", "tokens", "response_length", "loss_mask"])

    out = f"{session} {kind}, row int, tokens array<int>, response_length int, loss_mask array<int>"
    return stream.groupBy(session).applyInPandasWithState(build, out, "held array<string>", "append", waiting(wait_ms))
