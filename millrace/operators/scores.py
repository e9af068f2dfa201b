"""Scores of rows that a column expression can't make: overlaps of long texts, and rewards routed by type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math_answers import boxed_column
from ..functions.rewards import routed_reward
from ..functions.text import normalize_answer, trimmed, words


def token_f1_rows(df: DataFrame, key: str, prediction: str, gold: str) -> DataFrame:
    """(key, f1, precision, recall): multiset overlap of normalised words, whole texts of any length; `key` tells the rows apart.

    Words are counted before they are shuffled. yes, no and noanswer must agree exactly; without overlap all are 0."""
    bare = df.select(key, normalize_answer(F.col(prediction)).alias("p"), normalize_answer(F.col(gold)).alias("g"))
    said = lambda c, n: F.transform(words(F.col(c)), lambda w: F.struct(w.alias("w"), F.lit(n).alias("side")))
    # Both sides leave a row together: the halves of a union could be planned anew in different ways, and then no longer fit a join above.
    each = bare.select(key, F.explode(F.concat(said("p", 0), said("g", 1))).alias("e")).select(key, "e.*")
    counts = each.groupBy(key, "w").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    total = counts.groupBy(key).agg(F.sum(F.least("a", "b")).alias("same"), F.sum("a").alias("said"), F.sum("b").alias("wanted"))
    fixed = F.array(F.lit("yes"), F.lit("no"), F.lit("noanswer"))
    clash = bare.select(key, ((F.col("p") != F.col("g")) & (F.array_contains(fixed, F.col("p")) | F.array_contains(fixed, F.col("g")))).alias("clash"))
    share = lambda x: F.when(F.col("clash"), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))
    same = F.col("same").cast("double")
    parts = [share(F.try_divide(2.0 * same, F.col("said") + F.col("wanted"))).alias("f1"), share(F.try_divide(same, F.col("said"))).alias("precision"), share(F.try_divide(same, F.col("wanted"))).alias("recall")]
    return clash.join(total, key, "left").select(key, *parts)


def routed_rewards(df: DataFrame, kind: str, response: str, label: str, observed: Column | None = None, scorers: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """`df` with `reward`, by the type in `kind`; `boxed_` before a type scores the last boxed answer of the response."""
    boxed = F.startswith(trimmed(F.col(kind)), F.lit("boxed_"))
    text = F.when(boxed, F.coalesce(boxed_column(F.when(boxed, F.col(response))), F.lit(""))).otherwise(F.col(response))
    ready = df.withColumn("__text", text).withColumn("__kind", F.regexp_replace(trimmed(F.col(kind)), "^boxed_", ""))
    return ready.withColumn("reward", routed_reward(F.col("__kind"), F.col("__text"), F.col(label), scorers, observed)).drop("__text", "__kind")
