"""Running values over value ranges against plain loops."""

import random

from pyspark.sql import functions as F

from millrace.operators import groups as G
from millrace.operators import ranking as N
from millrace.operators import selection as S


def test_numbers_and_maxima_equal_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 1, 2]), rng.choice([None, *range(40)]), rng.randrange(100)) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, g int, o int, v int")
    for n in (1, 9):
        got = {r["id"]: r["n"] for r in N.numbered_by(df.repartition(n), "n", "o", ["id"], ["g"]).collect()}
        top = {r["id"]: r["m"] for r in N.running_max(df.repartition(n), F.col("v"), "m", "o", ["id"]).collect()}
        ordered = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        seen, most = {}, -1
        for i, g, _, v in ordered:
            most = max(most, v)
            assert got[i] == seen.get(g, 0) and top[i] == most
            seen[g] = seen.get(g, 0) + 1


def test_empty_and_constant_orders(spark):
    df = spark.createDataFrame([], "id int, o bigint")
    assert N.numbered_by(df, "n", "o", ["id"]).collect() == []
    same = spark.range(50).withColumn("o", F.lit(None).cast("double"))
    assert sorted(r["n"] for r in N.numbered_by(same, "n", "o", ["id"]).collect()) == list(range(50))


def test_missing_ids_take_the_smallest_free_numbers(spark):
    rng = random.Random(6)
    for used in ([], [0, 1, 2, 5, 6, 9], rng.sample(range(400), 150)):
        rows = [(i, u) for i, u in enumerate(used)] + [(1000 + i, None) for i in range(200)]
        got = {r["k"]: r["w"] for r in G.filled_ids(spark.createDataFrame(rows, "k int, w int").repartition(5), "k", "w").collect()}
        free = (n for n in range(10**6) if n not in set(used))
        assert got == {**dict(rows[: len(used)]), **{1000 + i: next(free) for i in range(200)}}


def test_cursor_of_a_hot_source(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("s"))
    lengths = spark.createDataFrame([("hot", 7), ("cold", 30)], "source string, length int")
    got = sorted((r["id"], r["epoch"], r["position"]) for r in S.source_cursor(df.repartition(4), "s", "id", lengths).filter("s = 'hot'").collect())
    assert [(e, p) for _, e, p in got] == [(i // 7, i % 7) for i in range(200)]


def test_a_constant_column_spreads_over_all_ranges(spark):
    df = spark.range(200_000).withColumn("o", F.lit(7))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would be one range
    try:
        parts = [r["count"] for r in N.in_ranges(df, "o").groupBy(N.PART).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 8 and max(parts) < 40_000
    got = N.numbered_by(df, "n", "o").agg(F.count_distinct("n").alias("d"), F.min("n").alias("a"), F.max("n").alias("b")).first()
    assert tuple(got) == (200_000, 0, 199_999)


def test_quantiles_equal_interpolation(spark):
    import numpy as np

    rng = random.Random(8)
    rows = [(g, rng.choice([5.0, 5.0, 5.0, rng.random() * 10])) for g in ("a", "b", None) for _ in range(301)] + [("c", None), ("d", 2.5), ("e", 7.0)] + [("e", 7.0)] * 99
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"low": 0.1, "mid": 0.5, "high": 0.99, "top": 1.0}
    got = {r["g"]: r for r in N.with_quantiles(df, ["g"], "v", shares, F.count("v").alias("n")).collect()}
    for g in {r[0] for r in rows}:
        values = [v for k, v in rows if k == g and v is not None]
        assert got[g]["n"] == len(values)
        for name, q in shares.items():
            assert (got[g][name] is None) if not values else abs(got[g][name] - np.quantile(values, q)) < 1e-12
    assert abs(N.exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] - np.quantile([v for _, v in rows if v is not None], 0.5)) < 1e-12


def test_kept_or_filled_equals_a_loop(spark):
    from millrace.operators.metrics import kept_or_filled

    rng = random.Random(9)
    for target in (0, 5, 40, 200):
        rows = [(i, rng.random() < 0.3) for i in range(120)]
        have = used = 0
        want = {}
        for i, keep in rows:
            have += keep
            asked = keep or have + len(rows) - i - 1 < target
            used += asked
            want[i] = ("kept" if keep else "filled") if asked and used <= target else "surplus" if keep else "dropped"
        got = kept_or_filled(spark.createDataFrame(rows, "i int, keep boolean").repartition(5), "i", "keep", target).collect()
        assert {r["i"]: r["state"] for r in got} == want
