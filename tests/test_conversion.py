"""Rewards by blocks, training columns, batch means, counters and run rules, by hand."""

import statistics

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import conversion as V
from millrace.operators.metrics import cumulative_counters
from millrace.operators.ordered import run_faults
from millrace.operators.scores import token_f1_rows


def rewards(spark, values, *how, **more):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "at int, reward double").repartition(3)
    return [r.normalised for r in V.block_rewards(df, "at", "reward", *how, **more).orderBy("at").collect()]


def test_rewards_of_blocks_and_of_the_whole_batch(spark):
    values = [0.0, 1.0, 3.0, 3.0, 1.0, 0.0]
    scaled = lambda xs: [(x - statistics.mean(xs)) / (statistics.stdev(xs) + 1e-6) for x in xs]
    assert rewards(spark, values, "grpo", 2, 3) == pytest.approx(scaled(values[:2]) + [0.0, 0.0] + scaled(values[4:]))
    assert rewards(spark, values, "gspo", 4, 2) == pytest.approx(scaled(values))  # six aren't four times two
    assert rewards(spark, values, "reinforce_plus_plus_baseline", 3, 2) == pytest.approx([x - 4 / 3 for x in values])
    assert rewards(spark, values, "cispo", 2, 3, scale=False) == pytest.approx([-0.5, 0.5, 0.0, 0.0, 0.5, -0.5])
    assert rewards(spark, values, "ppo", 2, 3) == values and rewards(spark, values, "grpo", 2, 3, normalise=False) == values
    assert rewards(spark, [2.0, 5.0], "grpo", 1, 2) == [None, None]


SAMPLES = "at int, rollout_id int, response_length int, loss_mask array<int>, remove_sample boolean, status string, metadata map<string,string>, reward double, index int"


def test_training_columns(spark):
    rows = [
        (0, None, 2, None, None, "completed", None, 1.0, 7), (1, 1, 3, [1, 0, 1], False, "truncated", {"raw_reward": "0.25"}, 1.0, 8), (2, 1, 2, [1, 1], True, None, {"x": "y"}, 0.5, 9),
        (3, None, 0, [], False, "aborted", {}, None, 1), (4, 0, 1, None, False, "completed", None, 0.0, 2),
    ]
    got = {r.at: r for r in V.training_columns(spark.createDataFrame(rows, SAMPLES), "at").collect()}
    assert [got[k].rollout_id for k in range(5)] == [2, 1, 1, 3, 0]
    assert [got[k].loss_mask for k in range(5)] == [[1, 1], [1, 0, 1], [0, 0], [], [1]]
    assert [got[k].rollout_mask_sum for k in range(5)] == [2, 2, 2, 0, 1]
    assert [got[k].truncated for k in range(5)] == [0, 1, 0, 0, 0] and [got[k].raw_reward for k in range(5)] == [1.0, 0.25, 0.5, None, 0.0]
    assert [got[k]["index"] for k in range(5)] == [7, 8, 9, 1, 2]
    with pytest.raises(Exception, match="loss mask length 1 is not the response length 2"):
        V.training_columns(spark.createDataFrame([(0, 1, 2, [1], False, "completed", None, 1.0, 1)], SAMPLES), "at").collect()


def test_weights_of_a_batch(spark):
    df = spark.createDataFrame([("a", [2.0, 4.0], [1.0, 0.0]), ("b", [1.0, 1.0], [1.0, 1.0]), ("c", [9.0], [0.0])], "k string, w array<double>, m array<double>")
    got = lambda level, d=df: {r.k: r.w for r in V.batch_normalised(d, "w", "m", level).collect()}
    assert got("token")["a"] == pytest.approx([1.5, 3.0])  # (2 + 1 + 1) / 3
    assert got("sequence")["b"] == pytest.approx([1.0, 1.0])  # (2 + 1 + 0) / 3
    assert got("token", df.withColumn("w", F.transform("w", lambda w: w * 0)))["a"] == [0.0, 0.0]
    with pytest.raises(ValueError, match="geometric"):
        V.batch_normalised(df, "w", "m", "geometric")


def test_counters_refuse_replays(spark):
    df = spark.createDataFrame([(5, 10), (4, 1), (7, 100)], "rollout int, n int")
    counts = {"total": F.col("n").cast("bigint")}
    assert sorted((r.rollout, r.total) for r in cumulative_counters(df, "rollout", counts, {"rollout": 3, "total": 1000}).collect()) == [(4, 1001), (5, 1011), (7, 1111)]
    for last in (4, 9):
        with pytest.raises(ValueError, match="is a replay"):
            cumulative_counters(df, "rollout", counts, {"rollout": last})
    with pytest.raises(ValueError, match="comes twice"):
        cumulative_counters(df.union(df.limit(1)), "rollout", counts)
    assert cumulative_counters(df.limit(0), "rollout", counts, {"rollout": 3}).collect() == []


def test_faults_of_runs(spark):
    nan, inf = float("nan"), float("inf")
    train = [("ok", k, 1.0, 0) for k in range(4)] + [("high", k, v, None) for k, v in enumerate([5.0, nan, 6.0, 7.0])] + [("even", k, 5.0 if k != 2 else 1.0, k % 2) for k in range(4)] + [("cut", k, None, 1) for k in range(2)]
    evals = [("ok", 3, 0.5), ("high", 9, 0.5), ("high", 3, inf), ("even", 3, 0.1), ("cut", 1, None)]
    runs = [("ok", 3), ("high", 9), ("even", 3), ("cut", None), ("none", 1)]
    got = run_faults(spark.createDataFrame(train, "run string, step int, norm double, clipped int"), spark.createDataFrame(evals, "run string, step int, score double"), spark.createDataFrame(runs, "run string, updates int"), "run", 4.0)
    assert {r.run: r.faults for r in got.collect()} == {
        "ok": [], "high": ["score_not_finite", "norm_not_finite", "three_norms"], "even": [], "cut": ["incomplete", "final_missing", "norm_not_finite", "clipped"], "none": ["final_missing"],
    }


def test_fingerprints_and_overlaps(spark):
    row = spark.range(1).select(*[X.fingerprint(F.lit(t)).alias(f"c{k}") for k, t in enumerate(["ﬁnd ①２ Ⅳ!", "find 12 iv", "É-é", "a_b", ""])]).first()
    assert list(row) == ["find12iv", "find12iv", "éé", "ab", ""]
    df = spark.createDataFrame([(1, "the cat sat", "A cat ran slow!"), (2, "yes", "no"), (3, "", "x")], "k int, p string, g string")
    got = {r.k: (round(r.f1, 6), round(r.precision, 6), round(r.recall, 6)) for r in token_f1_rows(df, "k", "p", "g").collect()}
    assert got == {1: (0.4, 0.5, 0.333333), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_search_without_queries_or_with_null_vectors(spark):
    from millrace.operators.selection import dense_top_k

    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [None, 1.0])], "doc_id bigint, vector array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.5]), (8, None)], "query_id bigint, vector array<double>")
    assert [(r.query_id, r.doc_id, r.rank) for r in dense_top_k(queries, docs, 3).orderBy("rank").collect()] == [(7, 1, 1), (7, 3, 2)]
    assert dense_top_k(queries.limit(0), docs, 3).collect() == [] and dense_top_k(queries, docs.limit(0), 3).collect() == []
