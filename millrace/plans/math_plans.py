"""Graded answers: order totals written in other forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import algebra as A
from ..functions import math_answers as M
from ..functions import math_rewards as W
from .base import Registry, table

R = Registry()


@R.add(
    """SELECT o_orderkey, CASE o_orderkey%5 WHEN 0 THEN '\\boxed{'||o_custkey||'}' WHEN 1 THEN '\\fbox{\\frac{'||o_custkey||'}{2}}' WHEN 2 THEN '\\boxed '||o_custkey||' or {'||o_orderpriority||'}' END AS box,
CASE o_orderkey%5 WHEN 0 THEN o_custkey::VARCHAR END AS boxed FROM orders"""
)
def tx12_last_boxed(spark, sf):
    k, c, p = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.col("o_orderpriority")
    forms = [
        F.concat(F.lit("first \\boxed{0}, \\fbox{1}, then \\boxed{"), c, F.lit("} holds")),
        F.concat(F.lit("\\fbox{\\frac{"), c, F.lit("}{2}}.")),
        F.concat(F.lit("\\boxed{3} but \\boxed "), c, F.lit(" or {"), p, F.lit("}}")),
        F.concat(F.lit("\\boxed{"), c, F.lit(" and \\boxed{ open")),
        c,
    ]
    text = F.element_at(F.array(*forms), (k % 5 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", M.box_column(text).alias("box"), M.boxed_column(text).alias("boxed"))


@R.add(
    """WITH o AS (SELECT o_orderkey, o_custkey::HUGEINT AS k, (o_orderkey%3)::HUGEINT AS e, o_orderkey%8 AS form FROM orders),
places AS (SELECT *, unnest([4, 6, 15])::HUGEINT AS x FROM o)
SELECT o_orderkey, CASE WHEN form=7 THEN NULL WHEN form=6 THEN false ELSE bool_and(CASE form WHEN 0 THEN (x+2*k)*(x+2*k) = x*x+4*k*x+4*(k*k+e) WHEN 1 THEN (x+2*k)*(x-2*k) = x*x-4*(k*k+e) WHEN 2 THEN x*x-4*k*k = (x-2*k)*(x+2*(k+e))
 WHEN 3 THEN 3*k*k = 3*(k+e)*(k+e) WHEN 4 THEN k*(k+1+e) = (k+1)*(k+e) ELSE k+1 = k+1+e END) END AS correct
FROM places WHERE x<>2*k GROUP BY o_orderkey, form"""
)
def tx17_exact_equality(spark, sf):
    """Identities in the customer's number, of which two in three are spoilt; three letters are never read, a logarithm stays open.

    Its SQL compares in whole numbers, at x = 2, 3 and 7.5 taken twice, fractions multiplied out and roots squared (1/(sqrt(k)+sqrt(k+1)) is
    sqrt(k+1)-sqrt(k)), since doubles can't tell the sides apart where numbers are large."""
    k, e, form = F.col("o_custkey"), F.col("o_orderkey") % 3, F.col("o_orderkey") % 8
    square = k * k
    pairs = [
        (("(x+", k, ")^2"), ("x^2+2*", k, " x+", square + e)),
        (("(x+", k, ")(x-", k, ")"), ("x^2-", square + e)),
        (("(x^2-", square, ")/(x-", k, ")"), (k + e, "+x")),
        (("sqrt(", square * 3, ")"), (k + e, "sqrt(3)")),
        ((k, "/", k + 1), ("1-1/", k + 1 + e)),
        (("1/(sqrt(", k, ")+sqrt(", k + 1, "))"), ("sqrt(", k + 1 + e, ")-sqrt(", k, ")")),
        (("x+y+z+", k), ("z+y+x+", k)),
        (("ln(", square, ")"), ("2ln(", k, ")")),
    ]
    # Of all forms a row makes its own only.
    said = lambda parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    given, gold = (F.coalesce(*[F.when(form == i, said(parts)) for i, parts in enumerate(side)]) for side in zip(*pairs, strict=True))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")  # files have few groups of rows
    return orders.select("o_orderkey", A.same_expression_column(given, gold).alias("correct"))


def orders(spark, sf):
    return table(spark, sf, "orders").withColumn("k", F.col("o_orderkey"))


@R.add(
    """SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN '\\frac{'||o_orderkey||'}{7}' WHEN o_orderkey%3=1 THEN '\\sqrt{2}x' ELSE '0.25' END AS bare FROM orders"""
)
def tx14_bare_latex(spark, sf):
    text = F.when(F.col("k") % 3 == 0, F.format_string("x = %d/7", "k")).when(F.col("k") % 3 == 1, F.lit("\\left\\sqrt2 x^\\circ")).otherwise(F.lit(".25\\text{ cm}"))
    return orders(spark, sf).select("o_orderkey", W.bare_latex(text).alias("bare"))


@R.add("""SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN o_orderkey::VARCHAR WHEN o_orderkey%3=1 THEN o_orderkey||'+1/2' ELSE '3*10^6' END AS plain FROM orders""")
def tx15_plain_expression(spark, sf):
    text = F.when(F.col("k") % 3 == 0, F.format_string("\\$%,d.0", "k")).when(F.col("k") % 3 == 1, F.format_string("%d \\frac{1}{2} hours", "k")).otherwise(F.lit("3 million"))
    return orders(spark, sf).select("o_orderkey", W.plain_expression(text).alias("plain"))


@R.add("SELECT o_orderkey, o_orderkey%5<>0 AS same FROM orders")
def tx16_same_bare_latex(spark, sf):
    return orders(spark, sf).select("o_orderkey", W.same_bare_latex(F.format_string("\\dfrac{%d}{9}", "k"), F.format_string("%d/9", F.col("k") + (F.col("k") % 5 == 0).cast("int"))).alias("same"))


@R.add("SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS correct FROM orders")
def tx18_boxed_grade(spark, sf):
    k = F.col("k")
    answer = F.when(k % 4 == 0, F.format_string("\\boxed{%d.0}", k)).when(k % 4 == 1, F.format_string("\\boxed{%d/2}", k * 2)).when(k % 4 == 2, F.format_string("\\boxed{(%d, 0.5)}", k)).otherwise(F.lit("none"))
    gold = F.when(k % 4 == 2, F.format_string("\\boxed{(%d,1/2)}", k)).otherwise(k.cast("string"))
    return orders(spark, sf).select("o_orderkey", W.boxed_grade(answer, gold).alias("correct"))


@R.add("SELECT o_orderkey, (o_orderkey%3<>1)::INT AS reward FROM orders")
def tx19_reasoned_reward(spark, sf):
    k = F.col("k")
    text = F.when(k % 3 == 0, F.format_string("\\boxed{0}</think>\\boxed{%d}", k)).when(k % 3 == 1, F.format_string("\\boxed{%d}</think> I can't say", k)).otherwise(F.format_string("###Response \\boxed{%d}", k))
    return orders(spark, sf).select("o_orderkey", W.reasoned_reward(text, k.cast("string")).alias("reward"))


@R.add("SELECT o_orderkey, CASE WHEN o_orderkey%2=0 THEN o_orderkey::VARCHAR ELSE '\\frac{1}{2}' END AS answer FROM orders")
def tx20_final_answer(spark, sf):
    text = F.when(F.col("k") % 2 == 0, F.format_string("n = $%,d$ dollars", "k")).otherwise(F.lit("an x = \\frac12"))
    return orders(spark, sf).select("o_orderkey", W.final_answer(text).alias("answer"))


@R.add("SELECT o_orderkey, o_orderkey%3<>0 AS correct FROM orders")
def tx21_line_grade(spark, sf):
    text = F.format_string("Answer: 0\nso answer : $%d$ units", F.col("k") + (F.col("k") % 3 == 0).cast("int"))
    return orders(spark, sf).select("o_orderkey", W.line_grade(text, F.format_string("%d.0", "k")).alias("correct"))


@R.add("SELECT o_orderkey, CASE WHEN o_orderkey%2=0 THEN 1 ELSE -1 END AS score FROM orders")
def tx22_box_grade(spark, sf):
    text = F.concat(F.format_string("\\boxed{%d}", "k"), F.repeat(F.lit("."), F.when(F.col("k") % 2 == 0, 20).otherwise(120)))
    return orders(spark, sf).select("o_orderkey", W.box_grade(text, F.col("k").cast("string")).alias("score"))


@R.add("SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN -1.0 ELSE 1.0 END::DOUBLE AS score, o_orderkey%3<>0 AS acc, CASE WHEN o_orderkey%3=0 THEN '[INVALID]' ELSE o_orderkey::VARCHAR END AS pred FROM orders")
def tx23_answer_score(spark, sf):
    text = F.concat(F.format_string("Answer: %d\n", "k"), F.repeat(F.lit("."), F.when(F.col("k") % 3 == 0, 400).otherwise(50)))
    return orders(spark, sf).select("o_orderkey", W.answer_score(text, F.col("k").cast("string")).alias("s")).select("o_orderkey", "s.*")


@R.add("SELECT doc_id, NOT regexp_matches(CASE WHEN contains(text,'ing') THEN regexp_extract(text,'^[^.]*') ELSE '' END,'\\S') AND NOT (length(text)%5=0) AS valid FROM documents")
def tx4_tag_sequence(spark, sf):
    """Whole texts as thoughts, with as many searches between as their length says; a first sentence that stands outside of all tags, or
    a missing answer, spoils them."""
    text, n = F.col("text"), F.length("text")
    more = F.concat(F.lit(" <search>b</search>\n<information>"), text, F.lit("</information><think>c</think> "))
    outside = F.when(F.contains("text", F.lit("ing")), F.regexp_extract("text", "^[^.]*", 0)).otherwise(F.lit(""))
    end = F.when(n % 5 == 0, F.lit("")).otherwise(F.lit("<answer>d</answer>\n"))
    body = F.concat(F.lit("no one <|im_start|>assistant\n<think>"), text, F.lit("</think>"), F.repeat(more, (n % 3).cast("int")), outside, end)
    return table(spark, sf, "documents").select("doc_id", W.valid_tag_sequence(body).alias("valid"))


@R.add("SELECT o_orderkey, round(CASE WHEN o_orderkey%2=0 THEN 1.0::DOUBLE ELSE least(-0.6::DOUBLE, -1.0::DOUBLE+(o_orderkey%20-2)/2.0::DOUBLE*0.1::DOUBLE) END,6) AS reward FROM orders")
def ex13_tool_use_reward(spark, sf):
    reward = W.tool_use_reward(F.when(F.col("k") % 2 == 0, 1.0).otherwise(-1.0), F.col("k") % 20)
    return orders(spark, sf).select("o_orderkey", F.round(reward, 6).alias("reward"))
