"""Packing plans, record files, sinks and the streaming buffer."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import packing as P
from millrace.operators import sketches as K
from millrace.sources import records as D
from millrace.streaming import groups as B


def test_first_fit_and_splitting():
    lengths = [5, 9, 3, 12, 1, 4]
    assert P.first_fit(lengths, 10) == [[0, 2, 4], [1], [3], [5]]
    assert sorted(map(tuple, P.split_bin([0, 1, 2, 5], lengths))) == [(0, 5), (1, 2)]
    more = P.expanded(P.first_fit(lengths, 10), 6, lengths)
    assert len(more) == 6 and sorted(i for b in more for i in b) == list(range(6))
    assert P.expanded([[0]], 2, [1]) == [[0]]  # nothing is left to split


def test_differencing_is_balanced():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randrange(1, 100) for _ in range(rng.randrange(8, 40))]
        parts = P.differencing(lengths, 4)
        assert sorted(i for p in parts for i in p) == list(range(len(lengths))) and all(parts)
        spread = lambda ps: max(s := [sum(lengths[i] for i in p) for p in ps]) - min(s)
        assert spread(parts) <= spread(P.greedy(lengths, 4)) + max(lengths)
    assert P.differencing([8, 7, 6, 5, 4], 2) == [[4, 1, 3], [0, 2]]
    with pytest.raises(ValueError):
        P.balanced([1], 2)


def test_packed_steps_keep_their_bounds(spark):
    rng = random.Random(3)
    rows = [(i // 50, i, rng.randrange(1, 120)) for i in range(200)]
    df = spark.createDataFrame(rows, "step bigint, pos bigint, length int")
    got = [P.packed_steps(df.repartition(n), "step", "pos", "length", 4, 100).collect() for n in (1, 7)]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1])) and len(got[0]) == 200
    length = {i: n for _, i, n in rows}
    bins, ranks = {}, {}
    for r in got[0]:
        bins.setdefault((r["step"], r["micro_batch"]), []).append(length[r["pos"]])
        ranks.setdefault((r["step"], r["rank"]), set()).add(r["micro_batch"])
    assert all(sum(b) <= 100 or len(b) == 1 for b in bins.values())
    for step in range(4):
        assert len({len(b) for (s, _), b in ranks.items() if s == step}) == 1


def test_inverse_permutation(spark):
    assert spark.range(1).select(P.inverse_permutation(F.array(*map(F.lit, [2, 0, 1]))).alias("p")).first()["p"] == [1, 2, 0]


def test_mixer_equals_plain_arithmetic(spark):
    def plain(i, seed):
        x = (i + seed) & 0xFFFFFFFF
        x = ((x ^ x >> 16) * 0x7FEB352D) & 0xFFFFFFFF
        x = ((x ^ x >> 15) * 0x846CA68B) & 0xFFFFFFFF
        return x ^ x >> 16

    got = spark.range(0, 5000, 7).select("id", K.mixed32(F.col("id"), 4294967290).alias("h")).collect()
    assert all(r["h"] == plain(r["id"], 4294967290) for r in got)


def test_jsonl_slices_and_broken_lines(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text("".join(json.dumps({"id": i}) + "\n" + "\n" * (i == 3) for i in range(10)))
    ids = lambda part: [r["id"] for r in D.read_records(spark, f"{path}{part}", "id int").orderBy("row_pos").collect()]
    assert ids("") == list(range(10)) and ids("@[0:3]") == [0, 1, 2] and ids("@[3:]") == list(range(3, 10))
    assert ids("@[-2:]") == [8, 9] and ids("@[-99:4]") == [0, 1, 2, 3] and ids("@[:-7]") == [0, 1, 2]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": 1}\n{"id": \n{"id": 2}\n')
    assert D.read_records(spark, str(bad), "id int").count() == 2
    with pytest.raises(Exception):
        D.read_records(spark, str(bad), "id int", strict=True).collect()
    with pytest.raises(ValueError):
        D.read_records(spark, "x.txt")


def test_positions_span_partitions(spark):
    got = D.positioned(spark.range(0, 1000, 1, 7)).collect()
    assert all(r["id"] == r["row_pos"] for r in got)


def test_guarded_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    D.write_new(df, str(tmp_path / "out"))
    with pytest.raises(Exception):
        D.write_new(df, str(tmp_path / "out"))
    D.write_csv_union([df, spark.createDataFrame([(2.0,)], "b double")], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["b", "x", "y"]
    safe = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "v double").select(D.json_safe(F.col("v")).alias("v")).collect()
    assert sorted(str(r["v"]) for r in safe) == ["1.0", "None", "None"]


def test_groups_leave_when_complete(spark, tmp_path, sf):
    source = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.col("event_id").cast("string").alias("event_id"))
    events.repartition(5).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    done = B.complete_groups(stream, "event_type", 4, "event_id")
    q = done.writeStream.foreachBatch(B.idempotent_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = {r["event_type"]: r["count"] // 4 for r in events.groupBy("event_type").count().collect()}
    assert all(len(r["members"]) == 4 and not r["timed_out"] for r in got)
    assert {k: sum(r["event_type"] == k for r in got) for k in want} == want
    members = [m for r in got for m in r["members"]]
    assert len(members) == len(set(members))
