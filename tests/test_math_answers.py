"""Graded answers by hand."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import math_rewards as W
from millrace.functions.math_answers import last_boxed, same_answer


def test_last_boxed():
    assert last_boxed(r"\boxed{1} then \boxed{\frac{1}{2}}.") == r"\frac{1}{2}"
    assert last_boxed(r"\boxed{1") is None and last_boxed("") is None and last_boxed(None) is None


@pytest.mark.parametrize(
    ("given", "gold", "want"),
    [
        ("0.5", r"\frac{1}{2}", True), ("1,000", "1000", True), ("1 1/2", "3/2", True), ("(1, 2/4)", "(1,0.5)", True), ("(1,2)", "[1,2]", False), ("2", "3", False),
        (r"\text{Paris}", "paris", True), ("x+1", "1+x", True), ("2pi", "3pi", False), ("ln(4)", "2ln(2)", None), (None, "1", False), ("1/0", "2", False), ("-3", "-6/2", True),
    ],
)
def test_same_answer(given, gold, want):
    assert same_answer(given, gold) is want


def each(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_bare_latex_by_hand(spark):
    got = each(spark, W.bare_latex, r"\text{5 }", r"\frac1b", r"\frac1{72}", "0.5", "3/4", "03/4", r"\frac", r"5\text{ m}\text{ s}", "x=.5", None, "", r"\tfrac{1}{2}", "k = 7", "long = 7")
    assert got == ["5", r"\frac{1}{b}", r"\frac{1}{72}", r"\frac{1}{2}", r"\frac{3}{4}", "03/4", r"\frac", r"5\text{ m}\text{ s}", ".5", None, "", r"\frac{1}{2}", "7", "long=7"]


def test_final_answers_by_hand(spark):
    got = each(spark, W.final_answer, "x = 1,234", r"the $\frac12$ dollars", r"\boxed{7}", r"\text{blue}", r"\sqrt2", "", None)
    assert got == ["1234", r"\frac{1}{2}", "7", "blue", r"\sqrt{2}", "", None]


@pytest.mark.parametrize(
    ("given", "gold", "want"),
    [("2/4", "1/2", False), ("0.5", "1/2", True), ("4/2", "2", False), ("(1,0.5)", "(1,1/2)", True), ("[1,2]", "(1,2)", False), ("x+1", "1+x", True), ("2pi", "3pi", False), ("ln(4)", "2ln(2)", None), (None, "1", False), ("", "1", False)],
)
def test_graded(given, gold, want):
    assert W.graded(given, gold) is want


def test_rewards_of_missing_texts(spark):
    df = spark.createDataFrame([(None, "1"), ("", "1"), ("\\boxed{1}", None), ("\\boxed{1}", "")], "r string, g string")
    r, g = F.col("r"), F.col("g")
    got = df.select(W.boxed_grade(r, g).alias("a"), W.box_grade(r, g).alias("b"), W.valid_tag_sequence(r).alias("c"), W.answer_score(r, g).alias("d")).collect()
    assert [(x["a"], x["b"], x["c"]) for x in got] == [(False, -1, False)] * 4
