"""Stored rows as generators of samples, and rewards that a whole group decides, by the scorer that its rows name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window


class SampledRows:
    """One stored row (group, prompt, responses) becomes `n` samples: a stored response each, taken up again from the first where there
    are too few. Samples are counted over all rows of a group, in which rows come in order; a row without responses gives
    samples that are aborted and empty."""

    def __init__(self) -> None:
        self.index = 0

    def eval(self, row, n: int):
        answers = list(row["responses"] or [])
        for k in range(n):
            yield row["group_index"], row["prompt"], self.index, k, answers[k % len(answers)] if answers else "", "completed" if answers else "aborted"
            self.index += 1


def sampled_rows(stored: DataFrame, group: str, order: str, prompt: str, responses: str, n: int) -> DataFrame:
    """(group_index, prompt, index, k, response, status): `n` samples of each stored row, groups apart and rows in order."""
    spark: SparkSession = stored.sparkSession
    kind = dict(stored.dtypes)[group]
    function = udtf(SampledRows, returnType=f"group_index {kind}, prompt string, index bigint, k int, response string, status string")
    rows = stored.select(F.col(group).alias("group_index"), F.col(order).alias("at"), F.col(prompt).alias("prompt"), F.col(responses).alias("responses"))
    return function(rows.asTable().partitionBy("group_index").orderBy("at"), F.lit(n))


class Within:
    """Windows of a group, all along one order of its rows (by the length of their response, then itself), so that a single sort serves
    them all: the whole, the rows of the same response, and those up to the same length."""

    def __init__(self, group: str, response: str, length: str) -> None:
        ordered = Window.partitionBy(group).orderBy(length, response)
        self.whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        self.alike = ordered.rangeBetween(Window.currentRow, Window.currentRow)
        self.by_length = Window.partitionBy(group).orderBy(length)


#: Scorers of groups by name: from response, label and the group's windows to a number.
GROUP_SCORERS: dict[str, Callable[[Column, Column, Within], Column]] = {
    # The share of the group that gives the same answer.
    "agreement": lambda r, g, w: F.count("*").over(w.alike) / F.count("*").over(w.whole),
    # How many of the group are shorter, from 0 to 1; alone it is 0.
    "length_rank": lambda r, g, w: F.coalesce(F.try_divide(F.rank().over(w.by_length) - 1, F.count("*").over(w.whole) - 1), F.lit(0.0)),
    # Right answers, less the share of the group that has them: what everybody knows earns nothing.
    "surprise": lambda r, g, w: F.when(r == g, 1.0 - F.avg((r == g).cast("double")).over(w.whole)).otherwise(0.0),
}


def group_rewards(df: DataFrame, group: str, name: str, response: str, label: str, scorers: dict[str, Callable[[Column, Column, Within], Column]] | None = None) -> DataFrame:
    """`df` with `reward`, which the scorer that the row itself names makes of its whole group. Null responses count as empty ones. A group
    is a bounded number of samples. An unknown or missing name is an error."""
    within, r, g = Within(group, "__response", "__length"), F.col("__response"), F.col(label)
    ready = df.withColumn("__response", F.coalesce(response, F.lit(""))).withColumn("__length", F.length("__response"))
    known = scorers or GROUP_SCORERS
    scored = ready.withColumns({f"__{k}": score(r, g, within).cast("double") for k, score in known.items()})
    reward = F.when(F.lit(False), 0.0)
    for k in known:
        reward = reward.when(F.col(name) == k, F.coalesce(f"__{k}", F.lit(0.0)))
    reward = reward.otherwise(F.raise_error(F.concat(F.lit("no scorer of groups is called "), F.coalesce(name, F.lit("(none)")))).cast("double"))
    return scored.select(*df.columns, reward.alias("reward"))
