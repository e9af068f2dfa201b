"""Cursors, dumps, artifacts and geometry against plain computations."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import benchmarks as B
from millrace.operators import geometry as G
from millrace.sources import rollouts as L


def test_cursor_resumes_and_wraps_once(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    scan = lambda at, n: [(r["epoch"], r["epoch_pos"], r["k"]) for r in L.cursor_scan(df, "k", at, n, 7, 20).orderBy("epoch", "epoch_pos").collect()]
    assert scan(15, 10) == scan(15, 5) + scan(20, 5) and sorted(k for _, _, k in scan(0, 20)) == list(range(20))
    with pytest.raises(ValueError):
        scan(0, 21)


def test_cursor_state_is_replaced(spark, tmp_path):
    for offset in (5, 9):
        L.save_cursor(spark, str(tmp_path / "state"), 3, offset, 1, 2)
    assert L.restored_cursor(spark, str(tmp_path / "state"), 3) == {"offset": 9, "group_index": 1, "index": 2}


def test_groups_of_another_size_are_an_error(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (2,)], "g int")
    assert L.checked_groups(df, "g", 2).count() == 4
    with pytest.raises(Exception, match="hasn't 3 rows"):
        L.checked_groups(df, "g", 3).collect()


def test_manifest(spark):
    text = json.dumps({"sources": [{"name": "a", "path": "x.jsonl", "weight": 2}, {"name": "b", "path": "/y.parquet"}]})
    assert [tuple(r) for r in L.manifest(spark, text, "/base/").collect()] == [("a", "/base/x.jsonl", 2.0), ("b", "/y.parquet", 1.0)]
    with pytest.raises(ValueError):
        L.manifest(spark, json.dumps({"sources": [{"name": "a", "path": "x"}] * 2}), "/")


def test_dumps_replay_and_publish_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    L.dump_rollout(df, str(tmp_path / "d"), 4)
    assert sorted(map(tuple, L.replay_rollout(spark, str(tmp_path / "d"), 4).collect())) == [(1, "a"), (2, None)]
    with pytest.raises(Exception):
        L.dump_rollout(df, str(tmp_path / "d"), 4)
    path = str(tmp_path / "p")
    assert L.publish_once(df, path) and not L.publish_once(df.repartition(3), path)
    for other in (df.limit(1), df.unionByName(df), df.withColumn("y", F.lit("z"))):
        with pytest.raises(ValueError):
            L.publish_once(other, path)
    with pytest.raises(ValueError):
        L.expected_rows(df, str(tmp_path / "e"), 3)


def test_evaluation_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("d1", 1.0, {"test": "x", "k": "v"}), ("d1", 0.0, None), ("d2", 1.0, {"k": "y" * 9000})], "dataset string, reward double, metadata map<string,string>")
    L.save_evaluation(df, str(tmp_path / "e"), 7)
    got = spark.read.json(str(tmp_path / "e/rollout_7"))
    assert got.count() == 3 and "test" not in got.schema["metadata"].dataType.fieldNames()
    assert {r["dataset"]: r["rows"] for r in spark.read.json(str(tmp_path / "e/index_7")).collect()} == {"d1": 2, "d2": 1}
    with pytest.raises(Exception):
        L.save_evaluation(df, str(tmp_path / "e"), 7)


def test_metrics_traces_and_files(spark, tmp_path):
    for step in (1, 2):
        L.append_metrics(spark, str(tmp_path / "m"), "rollout/step", {"rollout/step": step, "perf/x": 0.5, "eval/y": step})
    assert {(r["namespace"], r["step"]) for r in spark.read.json(str(tmp_path / "m")).collect()} == {("perf", 1), ("perf", 2), ("eval", 1), ("eval", 2)}
    with gzip.open(tmp_path / "t.json.gz", "wt") as f:
        f.write(json.dumps({"traceEvents": [{"name": "k", "ts": 1.0, "dur": 2.0, "tid": 3}, {"name": "l"}]}, indent=1))
    assert sorted(r["name"] for r in L.trace_events(spark, str(tmp_path / "t.json.gz")).collect()) == ["k", "l"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.jsonl").write_text('{"i": 1}\n\n{"i": 2}\n')
    row = L.file_records(spark, str(tmp_path / "f")).first()
    assert (row["lines"], row["first_line"]) == (2, '{"i": 1}')
    a, b = (L.folder_fingerprint(spark, str(tmp_path / "f")).first() for _ in range(2))
    assert a == b and (a["files"], a["bytes"]) == (1, 19)


def test_supervised_feed_by_hand(spark):
    df = spark.createDataFrame([([5, 6, 7, 8], [0, 0, 1, 0]), ([5], [0]), ([], [])], "t array<int>, m array<int>")
    assert [(r["response_length"], r["loss_mask"]) for r in L.supervised_feed(df, "t", "m").collect()] == [(2, [1, 0]), (0, []), (0, [])]


def test_boxed_label_must_be_whole(spark):
    with pytest.raises(Exception, match="no boxed answer"):
        spark.range(1).select(L.boxed_label(F.lit("so \\boxed{1}"))).collect()


def test_spectra_equal_a_decomposition(spark):
    rng = np.random.default_rng(2)
    mats = {"a": rng.normal(size=(50, 8)), "b": rng.normal(size=(30, 2)) @ rng.normal(size=(2, 8)), "zero": np.zeros((3, 8))}
    rows = [(k, r.tolist()) for k, m in mats.items() for r in m]
    df = spark.createDataFrame(rows, "k string, row array<double>").repartition(6)
    exact = {r["k"]: r for r in G.matrix_diagnostics(df, "k", "row").collect()}
    sketch = {r["k"]: r for r in G.matrix_diagnostics(df, "k", "row", method="sketch", rank=16).collect()}
    for k, m in mats.items():
        s = np.linalg.svd(m, compute_uv=False)
        for found in (exact[k], sketch[k]):  # sixteen projections of eight columns lose nothing
            assert found["rows"] == len(m) and abs(found["spectral_norm"] - s[0]) < 1e-6
        if k != "zero":
            p = s**2 / (s**2).sum()
            assert abs(exact[k]["entropy"] + (p[p > 1e-15] * np.log(p[p > 1e-15])).sum()) < 1e-6 and abs(exact[k]["stable_rank"] - (s**2).sum() / s[0] ** 2) < 1e-6
    assert exact["b"]["rank_99"] <= 2 and sketch["b"]["rank_99"] <= 2 and exact["zero"]["rank_99"] == 0 and (exact["a"]["method"], sketch["a"]["method"]) == ("exact", "sketch")
    with pytest.raises(Exception, match="not finite"):
        G.matrix_diagnostics(spark.createDataFrame([("a", [1.0, float("nan")])], "k string, row array<double>"), "k", "row").collect()


def test_principal_angles_by_hand(spark):
    turn = np.radians(30)
    a = np.array([[1, 0], [0, 1], [0, 0.0]])
    b = np.array([[1, 0], [0, np.cos(turn)], [0, np.sin(turn)]])
    df = spark.createDataFrame([("m", x.tolist(), y.tolist()) for x, y in zip(a, b)], "k string, a array<double>, b array<double>").repartition(3)
    r = G.principal_angles(df, "k", "a", "b").first()
    assert abs(r["max_deg"] - 30) < 1e-5 and abs(r["mean_deg"] - 15) < 1e-5 and abs(r["rms_sin"] - np.sqrt(0.125)) < 1e-6


def test_vectors_with_zero_norm_and_not_finite(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 2.0)], "g int, a double, b double")
    r = G.grouped_geometry(df, ["g"], ["a", "b"], [("a", "b")]).first()
    assert (r["a_l2"], r["a_zero_fraction"], r["a_b_cosine"]) == (0.0, 1.0, None)
    with pytest.raises(Exception, match="not finite"):
        G.grouped_geometry(df.withColumn("a", F.lit(float("inf"))), ["g"], ["a"], []).collect()


def test_extensions_by_hand(spark):
    links = ["https://a.org/x/y.html", "https://a.org/x/.html", "https://a.org/x", "https://a.org/x.tar.gz", "https://a.org"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(links)], "i int, l string").orderBy("i")
    assert [r[0] for r in df.select(B.link_extension(F.col("l"))).collect()] == [".html", "", "", ".gz", ".org"]


def test_sampler_state_belongs_to_its_configuration(spark, tmp_path):
    place = str(tmp_path / "sampler")
    L.save_sampler(spark, place, {"seed": 1, "mode": "a"}, {"x": 3})
    L.save_sampler(spark, place, {"mode": "a", "seed": 1}, {"x": 4, "y": 0})
    assert L.restored_sampler(spark, place, {"seed": 1, "mode": "a"}) == {"x": 4, "y": 0}
    with pytest.raises(ValueError):
        L.restored_sampler(spark, place, {"seed": 2, "mode": "a"})
