"""From samples to training columns: rewards by blocks of a batch, masks, ids and sums by rollout, and weights of a whole batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .groups import filled_ids
from .ranking import numbered_by

CENTRED = ("grpo", "gspo", "cispo", "reinforce_plus_plus_baseline")
SCALED = ("grpo", "gspo", "cispo")


def block_rewards(df: DataFrame, position: str, reward: str, estimator: str, per_prompt: int, prompts: int, normalise: bool = True, scale: bool = True, name: str = "normalised") -> DataFrame:
    """`df` with `name`: rewards less the mean of their group, for estimators of groups; also over the sample deviation (and 1e-6), for those
    that scale. Groups are blocks of `per_prompt` neighbours by `position`, if the batch has exactly `prompts` of them; else the
    whole batch is one. The rewards of other estimators stay as they are. A single sample has no deviation, so it is null."""
    value = F.col(reward).cast("double")
    if not normalise or estimator not in CENTRED:
        return df.withColumn(name, value)
    scales = scale and estimator in SCALED
    out = lambda mean, std: (value - mean) / (std + 1e-6) if scales else value - mean
    if df.count() == per_prompt * prompts:
        block = Window.partitionBy("__block")
        placed = numbered_by(df, "__at", position).withColumn("__block", F.floor(F.col("__at") / per_prompt))
        return placed.withColumn(name, out(F.avg(value).over(block), F.stddev_samp(value).over(block))).drop("__at", "__block")
    whole = df.agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__std"))  # one row
    return df.join(F.broadcast(whole)).withColumn(name, out(F.col("__mean"), F.col("__std"))).drop("__mean", "__std")


def training_columns(samples: DataFrame, position: str, rewards: str = "reward") -> DataFrame:
    """Training columns of `samples` (position, rollout_id, response_length, loss_mask, remove_sample, status, metadata as a map of texts, `rewards`, and
    what else they have): rollout_id, missing ones by the smallest numbers that are free; loss_mask, all ones where it is
    missing, all zeros where the sample is removed, and an error where it isn't as long as the response; truncated;
    rollout_mask_sum, over all samples of the rollout; raw_reward, by the metadata where they tell it."""
    ids = filled_ids(samples, position, "rollout_id")
    n = F.col("response_length").cast("int")
    given = F.coalesce("loss_mask", F.array_repeat(F.lit(1), n))
    wrong = F.raise_error(F.concat(F.lit("loss mask length "), F.size(given).cast("string"), F.lit(" is not the response length "), n.cast("string"))).cast("array<int>")
    mask = F.when(F.size(given) != n, wrong).when(F.coalesce("remove_sample", F.lit(False)), F.array_repeat(F.lit(0), n)).otherwise(given)
    told = F.try_element_at("metadata", F.lit("raw_reward")).cast("double")
    ready = ids.withColumns({"loss_mask": mask, "truncated": F.coalesce((F.col("status") == "truncated").cast("int"), F.lit(0)), "raw_reward": F.coalesce(told, F.col(rewards).cast("double"))})
    ready = ready.withColumn("__sum", F.aggregate("loss_mask", F.lit(0).cast("bigint"), lambda s, x: s + x))
    sums = ready.groupBy("rollout_id").agg(F.sum("__sum").alias("rollout_mask_sum"))
    return ready.drop("__sum").join(sums, "rollout_id")


def batch_normalised(df: DataFrame, weights: str, mask: str, level: str) -> DataFrame:
    """`df` with `weights` divided by their mean over the batch: over all tokens that are masked in ("token"), or over sequences, of the mean of
    each ("sequence"). Other levels are an error. A mean of next to nothing divides nothing. One row is what comes together."""
    if level not in ("token", "sequence"):
        raise ValueError(f"weights of level {level} have no mean of a batch")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    held, taken = total(F.zip_with(weights, mask, lambda w, m: w * m)), total(F.transform(mask, lambda m: m.cast("double")))
    mean = F.sum(held) / F.greatest(F.sum(taken), F.lit(1.0)) if level == "token" else F.avg(held / F.greatest(taken, F.lit(1.0)))
    one = df.agg(mean.alias("__mean"))
    by = F.when(F.col("__mean") > 1e-8, F.col("__mean")).otherwise(1.0)
    return df.join(F.broadcast(one)).withColumn(weights, F.transform(weights, lambda w: w / by)).drop("__mean")
