"""Advantages by estimator, the composed policy loss, and rows of mixed supervision, over the arrays of `tokens`."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as T


def advantages(estimator: str, reward: Column, kl: Column, mask: Column, values: Column | None = None, beta: float = 0.0, gamma: float = 1.0, lam: float = 1.0) -> tuple[Column, Column]:
    """(advantages, returns) of each token. grpo, gspo and cispo spread the reward; ppo adds it to the last token of -beta * kl
    and estimates against `values`; reinforce_plus_plus discounts, and its baseline form doesn't."""
    if estimator in ("grpo", "gspo", "cispo"):
        out = T.broadcast_reward(reward, kl)
        return out, out
    if estimator == "ppo":
        step = F.transform(kl, lambda k, i: -beta * k + F.when(i == F.size(kl) - 1, reward).otherwise(0.0))
        out = T.gae(step, values, gamma, lam)
        return out, F.zip_with(out, values, lambda a, v: a + v)
    if estimator == "reinforce_plus_plus":
        out = T.shaped_returns(reward, kl, mask, beta, gamma)
        return out, out
    if estimator == "reinforce_plus_plus_baseline":
        out = T.baseline_advantages(reward, kl, beta)
        return out, out
    raise ValueError(f"no such estimator: {estimator}")


def whitened(df: DataFrame, xs: str, mask: str, shift_mean: bool = True) -> DataFrame:
    """`df` with `xs` whitened over all unmasked tokens of the table: mean and sample variance are merged from parts about
    their own means, so large means don't cancel. One row of statistics is broadcast."""
    stats = df.select(F.explode(T.kept(F.col(xs), F.col(mask))).alias("x")).agg(F.avg("x").alias("__mean"), F.var_samp("x").alias("__var"))
    scale = 1 / F.sqrt(F.col("__var") + 1e-8)
    out = F.transform(xs, lambda x: (x - F.col("__mean")) * scale + (F.lit(0.0) if shift_mean else F.col("__mean")))
    return df.join(F.broadcast(stats)).withColumn(xs, out).drop("__mean", "__var")


def policy_terms(
    logp: Column, old: Column, advantage: Column, mask: Column, entropy: Column, reference: Column | None = None, rollout: Column | None = None, estimator: str = "grpo",
    eps_low: float = 0.2, eps_high: float = 0.2, dual: float | None = None, off_policy: float | None = None, entropy_weight: float = 0.0, kl_weight: float = 0.0, kl_kind: str = "k1",
    unbiased_kl: bool = False, clamp_is: tuple[float, float] | None = None, mask_sum: Column | None = None,
) -> dict[str, Column]:
    """What one sample adds to each reported metric, as token means (over `mask_sum`, if it is given): loss, pg_loss,
    entropy_loss, pg_clipfrac, ppo_kl and, where asked for, kl_loss, ois, tis and train_rollout_logprob_abs_diff. Their sums over
    the samples are the reported values."""
    mean = lambda xs: T.masked_sum(xs, mask) / F.greatest(mask_sum if mask_sum is not None else T.total(mask), F.lit(1.0))
    kl = T.sequence_kl_tokens(logp, old, mask) if estimator == "gspo" else F.zip_with(old, logp, lambda o, p: o - p)
    loss, clipped = T.policy_loss(kl, advantage, eps_low, eps_high, dual)
    if estimator == "cispo":
        loss = T.cispo_loss(kl, logp, advantage, eps_low, eps_high)
        clipped = F.transform(kl, lambda k: F.when((F.exp(-k) < 1 - eps_low) | (F.exp(-k) > 1 + eps_high), 1.0).otherwise(0.0))
    if off_policy is not None:
        loss = T.times(loss, T.off_policy_mask(logp, old, mask, advantage, off_policy))
    out: dict[str, Column] = {}
    if clamp_is is not None:
        weight = T.truncated_is(old, rollout, *clamp_is)
        loss = T.times(loss, weight)
        out |= {"ois": mean(F.transform(kl, lambda k: F.exp(-k))), "tis": mean(F.zip_with(old, rollout, lambda o, r: F.exp(o - r)))}
    out |= {"pg_loss": mean(loss), "pg_clipfrac": mean(clipped), "ppo_kl": mean(kl), "entropy_loss": mean(entropy)}
    total = out["pg_loss"] - entropy_weight * out["entropy_loss"]
    if reference is not None:
        ratio = F.zip_with(logp, old, lambda p, o: F.exp(p - o)) if unbiased_kl else None
        out["kl_loss"] = mean(T.approx_kl(logp, reference, kl_kind, ratio))
        total = total + kl_weight * out["kl_loss"]
    if rollout is not None:
        out["train_rollout_logprob_abs_diff"] = mean(F.zip_with(old, rollout, lambda o, r: F.abs(o - r)))
    return out | {"loss": total}


def neutral_teacher(mode: Column, student: Column, teacher: Column) -> Column:
    """Supervised rows take the student's own values, so that distillation leaves them alone."""
    return F.when(mode == "sft", student).otherwise(teacher)


def marked_teacher(mode: Column, logprobs: Column, length: Column) -> Column:
    """Teacher values by mode: the tail of what the teacher said, or zeros of the response's length; another mode is an error."""
    from .samples import teacher_tail

    zeros = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(length, F.lit(1))), F.lit(1), length), lambda _: F.lit(0.0))
    return F.when(mode == "opd", teacher_tail(logprobs, length)).when(mode == "sft", zeros).otherwise(F.raise_error(F.lit("neither sft nor opd")).cast("array<double>"))


def combined_reward(task_reward: Column, weight: float) -> Column:
    return task_reward * weight


def appended_response(tokens: Column, mask: Column, logprobs: Column, more: Column, more_logprobs: Column, trainable: Column) -> Column:
    """tokens, mask and logprobs with one more stretch: its mask is 1 where it is trained; missing values become zeros, and
    a stretch that is trained must have one for each token."""
    fits = F.coalesce(F.size(more_logprobs) == F.size(more), F.lit(False))
    filled = F.when(fits, more_logprobs).when(~trainable, F.transform(more, lambda _: F.lit(0.0))).otherwise(F.raise_error(F.lit("a trained token has no value")).cast("array<double>"))
    flags = F.transform(more, lambda _: F.when(trainable, 1).otherwise(0))
    return F.struct(F.concat(tokens, more).alias("tokens"), F.concat(mask, flags).alias("mask"), F.concat(logprobs, filled).alias("logprobs"))


def int32_array(encoded: Column) -> Column:
    """The little-endian 32-bit numbers of a base64 text; bytes that are no multiple of four are an error."""
    import base64

    @F.pandas_udf("array<int>")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.frombuffer(base64.b64decode(t), dtype="<i4"), na_action="ignore")

    return read(encoded)
