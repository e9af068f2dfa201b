"""Streams of the group buffer, run to their end: whole, late and timed-out groups."""

import datetime as dt
import json
import time

import pytest

from millrace.streaming.buffers import buffered_groups, group_meta, use_rocksdb

SCHEMA = "grp string, id int, reward double, ts timestamp"


@pytest.fixture()
def rocks(spark):
    use_rocksdb(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"grp": g, "id": i, "reward": r, "ts": (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)).isoformat()}) for g, i, r, s in rows]
    (folder / f".{name}").write_text("\n".join(lines))
    (folder / f".{name}").rename(folder / name)


def test_late_and_timed_out_groups(rocks, tmp_path):
    """Three files in turn. `a` is whole in the second; `b` waits until the third moves the watermark; a row of `b` that is older than
    the watermark is gone, a later one begins it anew."""
    source = tmp_path / "in"
    put(source, "1.json", [("a", 1, 1.0, 0), ("b", 2, 0.5, 1), ("c", 3, None, 2)])
    stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source)).withWatermark("ts", "5 seconds")
    groups = buffered_groups(stream, "grp", 3, 20_000)
    q = groups.writeStream.format("memory").queryName("buffered").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        q.processAllAvailable()
        put(source, "2.json", [("a", 4, 0.0, 3), ("a", 5, 0.5, 4), ("a", 6, 0.5, 5), ("c", 7, 1.0, 6)])
        q.processAllAvailable()
        found = {r.grp: r for r in rocks.table("buffered").collect()}
        assert set(found) == {"a"} and [m.id for m in found["a"].members] == [1, 4, 5, 6] and found["a"].n == 4 and found["a"].reward_mean == 0.5 and not found["a"].timed_out
        put(source, "3.json", [("d", 8, 1.0, 100)])
        q.processAllAvailable()
        put(source, "4.json", [("b", 9, 1.0, 3), ("b", 10, 1.0, 101), ("e", 11, 1.0, 300)])
        q.processAllAvailable()
        put(source, "5.json", [("e", 12, 1.0, 301)])
        q.processAllAvailable()
    finally:
        q.stop()
    rows = sorted((r.grp, [m.id for m in r.members], r.timed_out, r.reward_mean) for r in rocks.table("buffered").collect())
    assert rows == [("a", [1, 4, 5, 6], False, 0.5), ("b", [2], True, 0.5), ("b", [10], True, 1.0), ("c", [3, 7], True, 1.0), ("d", [8], True, 1.0)]
    meta = group_meta(rocks.table("buffered")).first()
    assert (meta.groups, meta.rows, meta.timed_out) == (5, 9, 4)


def test_groups_by_the_clock(rocks, tmp_path):
    source = tmp_path / "in"
    put(source, "1.json", [("a", 1, 1.0, 0), ("a", 2, 0.0, 9), ("b", 3, 1.0, 1)])
    stream = rocks.readStream.schema(SCHEMA).json(str(source))
    q = buffered_groups(stream, "grp", 2, 1000, by_event=False, ttl_ms=3_600_000).writeStream.format("memory").queryName("clocked").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while rocks.table("clocked").count() < 2 and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted((r.grp, r.n, r.timed_out) for r in rocks.table("clocked").collect()) == [("a", 2, False), ("b", 1, True)]
