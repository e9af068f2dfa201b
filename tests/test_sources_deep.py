"""Prompts over epochs and values that JSON can't hold, by hand."""

import math
import random
from collections import defaultdict

import pytest

from millrace.operators.selection import source_prompts
from millrace.sources.records import json_safe_rows


def test_epochs_are_permutations_that_differ(spark):
    rng = random.Random(1)
    requests = spark.createDataFrame([(k, rng.choice("ab")) for k in range(90)] + [(1000, "none")], "k int, s string").repartition(4)
    prompts = spark.createDataFrame([("a", p) for p in range(7)] + [("b", p) for p in range(5)], "s string, p int")
    got = source_prompts(requests, "s", "k", prompts, "p", 3).orderBy("k").collect()
    assert len(got) == 90
    epochs = defaultdict(list)
    for r in got:
        epochs[r.s, r.epoch].append(r.p)
    size = {"a": 7, "b": 5}
    for (s, _), given in epochs.items():
        assert len(set(given)) == len(given) and (len(given) == size[s] or (s, _) == max(k for k in epochs if k[0] == s))
    assert len({tuple(v) for (s, _), v in epochs.items() if s == "a" and len(v) == 7}) > 1
    plain = source_prompts(requests, "s", "k", prompts, "p", 3, shuffle=False).filter("s = 'b'").orderBy("k").collect()
    assert [r.p for r in plain] == [k % 5 for k in range(len(plain))]
    with pytest.raises(Exception, match="all prompts of"):
        source_prompts(requests, "s", "k", prompts, "p", 3, strict=True).collect()


def test_values_at_any_depth(spark):
    nan, inf = float("nan"), float("inf")
    row = (nan, [1.0, inf, None], {"x": -inf, "y": 2.0}, ([{"deep": nan}], 3.5), None, "nan")
    df = spark.createDataFrame([row, (1.5, None, None, None, (1.0,), None)], "a double, b array<double>, c map<string,double>, d struct<e:array<struct<deep:double>>,f:float>, g struct<h:double>, i string")
    one, two = json_safe_rows(df).collect()
    assert one.a is None and one.b == [1.0, None, None] and one.c == {"x": None, "y": 2.0} and one.d.e[0].deep is None and math.isclose(one.d.f, 3.5) and one.g is None and one.i == "nan"
    assert two.a == 1.5 and two.b is None and two.d is None and two.g.h == 1.0
