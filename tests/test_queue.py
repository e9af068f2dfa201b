"""The queue of record files: ranges, strictness, commits that count once, streaming with back-pressure."""

import io
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.sources import queue as Q


@pytest.fixture(scope="module")
def registered(spark):
    spark.dataSource.register(Q.RecordQueue)
    return spark


def test_every_line_is_in_one_range():
    rng = random.Random(1)
    for _ in range(60):
        data = b"".join(bytes(rng.choices(b"ab", k=rng.randint(0, 7))) + b"\n" for _ in range(rng.randint(0, 12))) + bytes(rng.choices(b"c", k=rng.randint(0, 5)))
        want, at = [], 0
        for line in data.split(b"\n"):
            want.append((at, line))
            at += len(line) + 1
        if not want[-1][1]:
            want.pop()
        for size in (1, 2, 3, 5, 100):
            Q.BLOCK, kept = rng.choice([1, 3, 64]), Q.BLOCK
            got = [x for s in range(0, len(data), size) for x in Q.lines_from(io.BytesIO(data), s, min(s + size, len(data)))]
            Q.BLOCK = kept
            assert got == want, (data, size)
    assert Q.line_number(io.BytesIO(b"a\nb\nc"), 4) == 3


def test_read_with_positions_and_errors(registered, tmp_path):
    rows = [{"id": k, "text": "é" * (k % 5)} for k in range(200)]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in rows[:120]) + "\n\nno json\n")
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(r) for r in rows[120:]))
    found = Q.queue_records(registered, str(tmp_path), bytes="97")
    got = found.select("row_pos", F.from_json("record", "id int, text string").alias("r")).select("row_pos", "r.*").orderBy("row_pos").collect()
    assert [(r.row_pos, r.id, r.text) for r in got] == [(k, r["id"], r["text"]) for k, r in enumerate(rows)]
    assert found.rdd.getNumPartitions() >= 1 and registered.read.format("record_queue").option("path", str(tmp_path)).option("bytes", "97").load().rdd.getNumPartitions() > 20
    with pytest.raises(Exception, match="a.jsonl, line 122: no JSON record"):
        registered.read.format("record_queue").option("path", str(tmp_path)).option("strict", "true").load().count()
    assert registered.read.format("record_queue").option("path", str(tmp_path / "b.jsonl")).load().count() == 80


def test_only_committed_writes_count(registered, tmp_path):
    path = str(tmp_path / "q")
    df = registered.range(0, 100, 1, 4).select("id", F.array(F.col("id")).alias("xs"))
    for _ in range(2):
        df.write.format("record_queue").mode("append").save(path)
    back = registered.read.format("record_queue").option("path", path).load()
    assert sorted(json.loads(r.record)["id"] for r in back.collect()) == sorted([*range(100)] * 2)
    assert Q.Folder(path).commits() == 2 and os.listdir(f"{path}/_open") == []
    broken = df.select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.lit("{}")).cast("string").alias("record"))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("record_queue").mode("append").save(path)
    assert Q.Folder(path).commits() == 2 and back.count() == 200 and os.listdir(f"{path}/_open") == []
    with pytest.raises(Exception, match="only added to"):
        df.write.format("record_queue").mode("overwrite").save(path)


def test_repeated_batches_commit_once(tmp_path):
    path = str(tmp_path / "q")

    class Row(dict):
        def asDict(self, recursive):
            return self

    def batch(batch_id):
        w = Q.QueueStreamWriter({"path": path}, False).streaming()
        w.commit([w.write(iter([Row(record="{}")])), None], batch_id)

    for k in (0, 0, 1, 1, 0, 2):
        batch(k)
    folder = Q.Folder(path)
    assert folder.commits() == 3
    folder.fs.delete_file(f"{path}/_batches/default.json")  # the note of batch 2 is lost, its commit isn't
    batch(2)
    assert folder.commits() == 3


def wait_for(what, seconds=60):
    end = time.time() + seconds
    while not what():
        assert time.time() < end, "nothing came"
        time.sleep(0.3)


def test_stream_stops_while_the_queue_is_full(registered, tmp_path):
    """Five commits wait; one goes with each batch, until two wait in the next queue. What the consumer takes makes room."""
    source, done, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for k in range(5):
        registered.range(k * 10, k * 10 + 10).write.format("record_queue").mode("append").save(source)

    def start():
        stream = registered.readStream.format("record_queue").option("path", source).option("commits_per_batch", "1").option("queue", done).option("capacity", "2").option("consumer", "trainer").load()
        return stream.select("record").writeStream.format("record_queue").option("path", done).option("checkpointLocation", check).trigger(processingTime="200 milliseconds").start()

    q = start()
    try:
        wait_for(lambda: Q.Folder(done).commits() == 2)
        time.sleep(2)
        assert Q.Folder(done).commits() == 2 and Q.Folder(source).load("_planned/default.json") == {"commit": 2}
        Q.Folder(done).save("_taken/trainer.json", {"commit": 1})
        wait_for(lambda: Q.Folder(done).commits() == 3)
        q.stop()
        q = start()  # goes on where it was
        Q.Folder(done).save("_taken/trainer.json", {"commit": 5})
        wait_for(lambda: Q.Folder(done).commits() == 5)
    finally:
        q.stop()
    got = sorted(json.loads(r.record)["id"] for r in registered.read.format("record_queue").option("path", done).load().collect())
    assert got == [*range(50)]
