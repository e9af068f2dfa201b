"""Streams over files, one file a batch, against the whole."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import trajectories as J
from millrace.streaming import rollouts as B


def files(df, path, n):
    """`df` as `n` files, in the order of its first column."""
    first = df.columns[0]
    rows = df.orderBy(first).collect()
    for i in range(n):
        part = rows[i * len(rows) // n : (i + 1) * len(rows) // n]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(path))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(stream, sink, state):
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_each_batch_takes_its_target(spark, tmp_path):
    df = spark.range(60).select("id", (F.col("id") / 2).cast("int").alias("g"), F.when(F.col("id") % 20 == 0, "aborted").otherwise("completed").alias("s"))
    run(files(df, tmp_path / "in", 5), B.take_groups(str(tmp_path / "out"), "g", "id", 4, "s"), tmp_path / "state")
    taken = spark.read.parquet(str(tmp_path / "out/taken")).collect()
    by_batch = {}
    for r in taken:
        by_batch.setdefault(r["batch"], set()).add(r["g"])
    assert [sorted(by_batch[b]) for b in range(5)] == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 11, 12, 13], [14, 15, 16, 17], [18, 19, 21, 22]] and len(taken) == 40
    left = spark.read.parquet(str(tmp_path / "out/carry/batch=4"))
    assert sorted({r["g"] for r in left.collect()}) == list(range(23, 30))
    again = spark.read.parquet(str(tmp_path / "out/requeue"))
    assert sorted({r["g"] for r in again.collect()}) == [0, 10, 20] and again.count() == 6


def test_chunks_fold_into_answers(spark, tmp_path):
    rows = [(0, "a", 0, "x", {"k": "1"}, None), (1, "b", 0, "p", None, None), (2, "a", 2, "z", {"k": "3"}, "stop"), (3, "a", 1, "y", {"k": "2", "m": "4"}, None), (4, "b", 1, "q", {}, None)]
    df = spark.createDataFrame(rows, "at int, request_id string, seq int, text string, metadata map<string,string>, finish_reason string")
    got = []
    run(B.folded_chunks(files(df, tmp_path / "in", 5)), lambda batch, i: got.extend(batch.collect()), tmp_path / "state")
    assert [(r["request_id"], r["text"], r["metadata"], r["finish_reason"], r["chunks"]) for r in got] == [("a", "xyz", {"k": "3", "m": "4"}, "stop", 3)]


def test_whole_answers_leave_and_others_are_carried(spark, tmp_path):
    rows = [(0, "a", 0, "x", {"k": "1"}, None), (1, "b", 0, "p", None, None), (2, "a", 2, "z", {"k": "3"}, "stop"), (3, "a", 1, "y", {"k": "2", "m": "4"}, None), (4, "b", 1, "q", {}, None), (5, None, 0, None, None, "length")]
    df = spark.createDataFrame(rows, "at int, request_id string, seq int, text string, metadata map<string,string>, finish_reason string")
    out = str(tmp_path / "out")
    run(files(df, tmp_path / "in", 6), B.whole_answers(out), tmp_path / "state")
    got = {r["request_id"]: tuple(r)[1:] for r in spark.read.parquet(f"{out}/out").collect()}
    assert got == {"a": ("xyz", {"k": "3", "m": "4"}, "stop", 3, 3), None: ("", {}, "length", 1, 5)}
    carried = spark.read.parquet(f"{out}/groups/batch=5/done=false").filter("rows is not null").collect()
    assert [(r["request_id"], len(r["rows"])) for r in carried] == [("b", 2)]


def test_spans_join(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    starts = spark.createDataFrame([(1, t(0)), (2, t(5)), (3, t(9))], "span int, ts timestamp")
    ends = spark.createDataFrame([(1, t(2)), (2, t(4)), (3, t(10))], "span int, ts timestamp")
    got = []
    joined = B.joined_spans(files(starts, tmp_path / "a", 2), files(ends, tmp_path / "b", 2), "span")
    run(joined, lambda batch, i: got.extend(batch.collect()), tmp_path / "state")
    assert sorted((r["span"], r["micros"]) for r in got) == [(1, 2_000_000), (3, 1_000_000)]


def test_uncommitted_rows_do_not_count(spark, tmp_path):
    path = str(tmp_path / "m")
    sink = B.committed_sink(path)
    for i in range(3):
        sink(spark.range(i + 1), i)
    sink(spark.range(2), 1)  # run again
    spark.range(7).write.parquet(f"{path}/rows/batch=3")
    assert B.committed_rows(spark, path).count() == 1 + 2 + 3 and B.archive_uncommitted(spark, path, "a") == 7


def test_sessions_leave_when_they_end(spark, tmp_path):
    u, a = ("user", "q"), ("assistant", "a")
    turns = [(0, "s", 1, [u], "a", [1], [2], [-1.0], "stop", False, False, False), (1, "t", 1, [u], "b", [1], [3], None, "stop", False, False, False), (2, "s", 2, [u, a, u], "c", [1, 2, 5], [6], None, "stop", False, False, True)]
    df = spark.createDataFrame(turns, "at int, s string, n int, " + J.TURN + ", ended boolean")
    got = []
    run(B.finished_sessions(files(df, tmp_path / "in", 3), "s", "n", "ended"), lambda batch, i: got.extend(batch.collect()), tmp_path / "state")
    assert [(r["s"], r["tokens"], r["loss_mask"]) for r in got] == [("s", [1, 2, 5, 6], [1, 0, 1])]
    assert J.training_rows(df.filter("s = 's'"), "s", "n").first()["tokens"] == [1, 2, 5, 6]


def test_ended_sessions_leave_and_others_are_carried(spark, tmp_path):
    u, a = ("user", "q"), ("assistant", "a")
    turns = [(0, "s", 1, [u], "a", [1], [2], [-1.0], "stop", False, False, False), (1, "t", 1, [u], "b", [1], [3], None, "stop", False, False, None), (2, "s", 2, [u, a, u], "c", [1, 2, 5], [6], None, "stop", False, False, True), (3, "s", 1, [u], "d", [1], [9], None, "stop", False, False, True)]
    df = spark.createDataFrame(turns, "at int, s string, n int, " + J.TURN + ", ended boolean")
    out = str(tmp_path / "out")
    run(files(df, tmp_path / "in", 4), B.ended_sessions(out, "s", "n", "ended"), tmp_path / "state")
    got = sorted((r["batch"], r["s"], r["tokens"], r["loss_mask"]) for r in spark.read.parquet(f"{out}/out").collect())
    assert got == [(2, "s", [1, 2, 5, 6], [1, 0, 1]), (3, "s", [1, 9], [1])]  # what comes later begins anew
