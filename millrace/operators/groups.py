"""Operators over groups of sibling samples: filters, normalisation, pass rates and reward statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import numbered_by, running_max, with_quantiles

#: Two-sided 95 % points of Student's t for 1 to 29 degrees of freedom; 1.96 beyond.
T95 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.16, 2.145, 2.131, 2.12, 2.11, 2.101, 2.093, 2.086, 2.08, 2.074, 2.069, 2.064, 2.06, 2.056, 2.052, 2.048, 2.045]


def varied_groups(df: DataFrame, group: str, reward: str, least: float = 1e-6) -> DataFrame:
    """Rows of groups whose sample deviation of the reward exceeds `least`; single rows have none and go."""
    keep = df.groupBy(group).agg(F.stddev_samp(reward).alias("__sd")).filter(F.coalesce(F.col("__sd") > least, F.lit(False))).select(group)
    return df.join(keep, group, "left_semi")


def filled_groups(df: DataFrame, group: str, reward: str, arrival: str, target: int) -> DataFrame:
    """Up to `target` groups: those with varied rewards by arrival, then, if they fall short, others by arrival.
    One row a group: group, varied, rank."""
    g = df.groupBy(group).agg(F.coalesce(F.stddev_samp(reward) > 1e-6, F.lit(False)).alias("varied"), F.min(arrival).alias("arrival"))
    top = g.orderBy(F.desc("varied"), "arrival", group).limit(target)  # a bounded top-k
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("varied"), "arrival", group))).select(group, "varied", "rank")


def drop_reasons(df: DataFrame, group: str, reward: str) -> DataFrame:
    """How many groups are dropped for each rounded reward that all of their rows share."""
    g = df.groupBy(group).agg(F.min(reward).alias("low"), F.max(reward).alias("high"))
    return g.filter("low = high").groupBy(F.concat(F.lit("zero_std_"), F.format_number(F.col("low"), 1)).alias("reason")).agg(F.count("*").alias("groups"))


def normalised(reward: Column, group: Window, by_std: bool = True) -> Column:
    """Reward less its group's mean, over the sample deviation plus 1e-6; null in groups of one."""
    centred = reward - F.avg(reward).over(group)
    return centred / (F.stddev_samp(reward).over(group) + 1e-6) if by_std else centred


def buffer_normalised(reward: Column, group: Window) -> Column:
    """Only rewards in [0, 1] count, with the population deviation; groups of zeros alone stay, those without spread
    become 0, and those without a counted reward are null."""
    ok = F.when(reward.between(0, 1), reward)
    mean, sd, most = F.avg(ok).over(group), F.stddev_pop(ok).over(group), F.max(ok).over(group)
    return F.when(most == 0, reward).when(sd == 0, F.lit(0.0)).otherwise((reward - mean) / sd)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased estimate from c passes in n."""
    miss = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1 - F.lit(float(k)) / i))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(1 - miss)


def pass_rates(df: DataFrame, group: str, reward: str, ks: list[int]) -> DataFrame:
    """Mean pass@k of groups with at least k rows; a pass is a reward of exactly 1."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(reward) == 1).alias("c"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col("n") >= k, pass_at_k(F.col("n"), F.col("c"), k)).alias("p")) for k in ks]))
    return g.select(each.alias("e")).select("e.*").groupBy("k").agg(F.avg("p").alias("pass_at_k"), F.count("p").alias("groups"))


def reward_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, deviation, extremes, tenths and share of passes of each group."""
    x = F.col(value)
    return with_quantiles(
        df, keys, value, {f"p{q}": q / 100 for q in (10, 50, 90)},
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(F.when(x == 1, 1.0).otherwise(0.0)).alias("pass_rate"),
    )


def estimates(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation and 95 % interval; a single value has neither deviation nor interval."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    t = F.when(F.col("n") <= len(T95) + 1, F.try_element_at(F.array(*map(F.lit, T95)), (F.col("n") - 1).cast("int"))).otherwise(1.96)
    half = F.when(F.col("n") > 1, t * F.col("sd") / F.sqrt("n"))
    return g.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def filled_ids(df: DataFrame, order: str, wanted: str) -> DataFrame:
    """Missing values of `wanted` become the smallest unused non-negative integers, in `order`.

    Below the r-th used number u lie u - r free ones, so the k-th missing row takes k plus the count of used numbers
    with u - r <= k: a running maximum over the missing rows and one row for each run of used numbers."""
    rows = df.withColumn("__wanted", F.col(wanted).cast("bigint"))
    used = numbered_by(rows.filter("__wanted >= 0").select("__wanted").distinct(), "__r", "__wanted")
    runs = used.groupBy((F.col("__wanted") - F.col("__r")).alias("__k")).agg((F.max("__r") + 1).alias("__skip"))
    missing = numbered_by(rows.filter(F.col(wanted).isNull()), "__k", order)
    both = missing.withColumn("__run", F.lit(1)).unionByName(runs.withColumn("__run", F.lit(0)), allowMissingColumns=True)
    filled = running_max(both, F.col("__skip"), "__skipped", "__k", ["__run"]).filter("__run = 1")
    filled = filled.withColumn(wanted, (F.col("__k") + F.coalesce("__skipped", F.lit(0))).cast(df.schema[wanted].dataType))
    return df.filter(F.col(wanted).isNotNull()).unionByName(filled.select(*df.columns))
