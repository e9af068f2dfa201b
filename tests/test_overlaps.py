"""Nodes that cover buckets, and overlaps of intervals of any length, against plain loops."""

import random

from pyspark.sql import functions as F

from millrace.operators import ordered as O


def test_nodes_cover_exactly(spark):
    rng = random.Random(2)
    pairs = [(a, a + rng.choice([0, 1, 2, 7, 100, 5000])) for a in (rng.randint(-300, 5000) for _ in range(200))]
    rows = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", O.covering_nodes(F.col("a").cast("double"), F.col("b").cast("double")).alias("nodes")).collect()
    for r in rows:
        covered = [x for n in r.nodes for x in range(n["at"] << n["level"], (n["at"] + 1) << n["level"])]
        assert sorted(covered) == list(range(r.a, r.b + 1)) and len(r.nodes) <= 2 * (r.b - r.a + 1).bit_length()


def test_first_op_of_each_gap_equals_a_loop(spark):
    rng = random.Random(3)
    span = lambda: (lambda a, n: (a, a + n))(rng.uniform(-50, 1000), rng.choice([0.0, 0.5, 3, 40, 900]))
    gaps, ops = [(k, *span()) for k in range(120)], [(k, f"op{k}", *span()) for k in range(150)]
    want = {}
    for g, a, b in gaps:
        first = next((name for _, name, s, e in ops if s < b and e > a), None)
        if first:
            want[g] = first
    out = O.overlapping(spark.createDataFrame(gaps, "gap_id int, `from` double, `to` double"), spark.createDataFrame(ops, "pos int, name string, start double, stop double"), 1.0)
    assert {r.gap_id: r.name for r in out.collect()} == want
