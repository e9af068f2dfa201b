"""Every registered query of the library against its SQL in DuckDB, on the smallest tables, and hand-derived values."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import plans
from millrace.functions import text as X
from millrace.functions import tokens as T
from millrace.operators import groups as G
from millrace.operators import ordered as O
from millrace.operators import selection as S

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v) if hasattr(v, "isoformat") else repr(float(v)) if v.__class__.__name__ == "Decimal" else repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in plans.SQL:
        r = duck.execute(plans.SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in r.fetchall())


def test_pass_at_k_of_one_in_ten(spark):
    df = spark.createDataFrame([(0, float(i == 0)) for i in range(10)], "g int, r double").repartition(7)
    assert {r["k"]: round(r["pass_at_k"], 6) for r in G.pass_rates(df, "g", "r", [1, 5, 10]).collect()} == {1: 0.1, 5: 0.5, 10: 1.0}


def test_curve_area_by_hand(spark):
    df = spark.createDataFrame([("a", 0, 0.2), ("a", 5, 0.6), ("a", 10, 0.2), ("b", 1, 1.0)], "run string, x int, y double")
    got = {r["run"]: (r["auc"], r["normalized_auc"]) for r in O.curve_area(df, ["run"], "x", "y").collect()}
    assert [round(v, 9) for v in got["a"]] == [4.0, 0.4] and got["b"] == (None, None)


def test_forgetting_by_hand(spark):
    df = spark.createDataFrame([("math", i, s) for i, s in enumerate([0.5, 0.9, 0.7])], "task string, i int, s double")
    last = O.forgetting(df, "task", "i", "s").filter("i = 2").first()
    assert (round(last["forgetting"], 9), round(last["backward_transfer"], 9)) == (0.2, 0.2)


def test_groups_of_one_have_no_deviation(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.0), (2, 1.0)], "g int, r double")
    assert [r["g"] for r in G.varied_groups(df, "g", "r").collect()] == [2, 2]


def test_cyclic_parents_have_depth_zero(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, 99), (8, 5)], "span bigint, parent bigint")
    assert {r["span"]: r["depth"] for r in O.span_depths(df).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 0, 6: 0, 7: 0, 8: 0}


def test_token_arrays_by_hand(spark):
    a = lambda *xs: F.array(*[F.lit(x) for x in xs])
    row = spark.range(1).select(
        T.discounted(a(1.0, 0.0, 2.0), 0.5).alias("d"), T.masked_min(a(1.0, 2.0), a(0.0, 0.0)).alias("m"), T.response_length(a(0, 1, 0, 1)).alias("n"),
        T.common_prefix(a(1, 2, 3), a(1, 2, 4)).alias("p"), T.sublist_positions(a(1, 2, 1, 2), a(1, 2)).alias("s"), T.merge_spans(a(7), a(0, 1), a(8, 9), a(0, 2))[1].alias("o"), T.pad_spans(a(0, 2), F.lit(3)).alias("q"),
    ).first()
    assert (row["d"], row["m"], row["n"], row["p"], row["s"], row["o"], row["q"]) == ([1.5, 1.0, 2.0], 0.0, 3, 2, [0, 2], [0, 1, 3], [0, 2, 2, 2])


def test_text_scores_by_hand(spark):
    one = spark.range(1)
    lit = F.lit
    row = one.select(
        X.token_f1(lit("the cat sat"), lit("A cat ran!")).alias("f1"), X.token_f1(lit("yes"), lit("no")).alias("clash"), X.choice_letter(lit("I think the answer is (C).")).alias("c"),
        X.last_answer(lit("<answer>x</answer><answer> y </answer>")).alias("a"), X.last_answer(lit("<answer>x</answer>")).alias("none"), X.fenced_python(lit("```python\nprint(1)\n```")).alias("code"), X.source_label(lit(""), lit("a b/c")).alias("s"),
    ).first()
    assert (row["f1"], row["clash"], row["c"], row["a"], row["none"], row["code"], row["s"]) == (0.5, 0.0, "C", "y", None, "print(1)", "a_b_c")


def test_samplers_keep_their_contracts(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    first, again, next_ = ([r["k"] for r in S.epoch_order(df.repartition(n), "k", 1, e).orderBy("epoch_pos").collect()] for n, e in ((1, 0), (7, 0), (7, 1)))
    assert first == again != next_ and sorted(first) == list(range(100))
    weights = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", 0.0)], "source string, weight double")
    assert {r["source"]: r["slots"] for r in S.stratified_slots(weights, 10).collect()} in ({"a": 8, "b": 2}, {"a": 7, "b": 3})
    picks = {r["k"]: r["pick"] for r in S.stride_sample(df, "k", 100, 3, 4, 30).collect()}  # 4 is raised to 7
    assert picks == {(3 + 7 * i) % 100: i for i in range(30)}
    assert S.holdout(df, "k", 10, 3).filter("held_out").count() == 10 and S.holdout(df.limit(1), "k", 10, 3).filter("held_out").count() == 0
    assert [r["k"] for r in S.head_and_tail(df, "k", 0.05).orderBy("k").collect()] == [0, 1, 97, 98, 99]
    assert S.sliced(df, "k", -1000, 3).count() == 3
