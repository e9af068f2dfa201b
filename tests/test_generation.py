"""Samples of stored rows and rewards of groups, by hand."""

import pytest

from millrace.operators.generation import group_rewards, sampled_rows


def test_samples_are_counted_over_their_group(spark):
    rows = [("a", 2, "q2", ["z"]), ("a", 1, "q1", ["x", "y"]), ("b", 1, "q3", []), (None, 1, "q4", None)]
    out = sampled_rows(spark.createDataFrame(rows, "g string, at int, q string, r array<string>"), "g", "at", "q", "r", 3).collect()
    got = sorted((r.group_index or "", r["index"], r.prompt, r.k, r.response, r.status) for r in out)
    assert got == [
        ("", 0, "q4", 0, "", "aborted"), ("", 1, "q4", 1, "", "aborted"), ("", 2, "q4", 2, "", "aborted"),
        ("a", 0, "q1", 0, "x", "completed"), ("a", 1, "q1", 1, "y", "completed"), ("a", 2, "q1", 2, "x", "completed"), ("a", 3, "q2", 0, "z", "completed"), ("a", 4, "q2", 1, "z", "completed"), ("a", 5, "q2", 2, "z", "completed"),
        ("b", 0, "q3", 0, "", "aborted"), ("b", 1, "q3", 1, "", "aborted"), ("b", 2, "q3", 2, "", "aborted"),
    ]


def test_rewards_of_groups(spark):
    rows = [(1, "agreement", "x", "x"), (1, "agreement", "x", "x"), (1, "surprise", "y", "y"), (1, "surprise", None, "y"), (2, "length_rank", "long", ""), (2, "length_rank", "", ""), (2, "length_rank", "mid", ""), (3, "length_rank", "alone", "")]
    df = spark.createDataFrame(rows, "g int, name string, r string, gold string")
    got = sorted((r.g, r.name, r.r or "", round(r.reward, 6)) for r in group_rewards(df, "g", "name", "r", "gold").collect())
    assert got == [(1, "agreement", "x", 0.5), (1, "agreement", "x", 0.5), (1, "surprise", "", 0.0), (1, "surprise", "y", 0.25), (2, "length_rank", "", 0.0), (2, "length_rank", "long", 1.0), (2, "length_rank", "mid", 0.5), (3, "length_rank", "alone", 0.0)]
    for name in ("'poetry'", "cast(null as string)"):
        with pytest.raises(Exception, match="no scorer of groups"):
            group_rewards(df.selectExpr("g", f"{name} AS name", "r", "gold"), "g", "name", "r", "gold").collect()


def test_one_sort_serves_all_scorers_of_a_group(spark):
    df = spark.createDataFrame([(1, "agreement", "x", "x")], "g int, name string, r string, gold string")
    plan = group_rewards(df, "g", "name", "r", "gold")._jdf.queryExecution().sparkPlan().toString()
    full = group_rewards(df, "g", "name", "r", "gold")._jdf.queryExecution().executedPlan().toString()
    assert full.count("- Sort [") == 1 and full.count("Exchange ") == 1 and plan.count("Window [") == 2
