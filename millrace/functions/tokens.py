"""Per-token algebra over the ARRAY columns of one row. Everything stays in built-in expressions.

Arrays of a row have equal lengths; a null array gives null. Masks hold 0 and 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    return F.greatest(F.least(x, F.lit(high) if isinstance(high, float) else high), F.lit(low) if isinstance(low, float) else low)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def times(xs: Column, mask: Column) -> Column:
    return F.zip_with(xs, mask, lambda x, m: x * m)


def masked_sum(xs: Column, mask: Column) -> Column:
    return total(times(xs, mask))


def masked_mean(xs: Column, mask: Column) -> Column:
    """The divisor is at least one."""
    return masked_sum(xs, mask) / F.greatest(total(mask), F.lit(1.0))


def kept(xs: Column, mask: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(xs.alias("x"), mask.alias("m")), lambda p: p["m"] > 0), lambda p: p["x"])


def masked_min(xs: Column, mask: Column) -> Column:
    return F.coalesce(F.array_min(kept(xs, mask)), F.lit(0.0))


def masked_max(xs: Column, mask: Column) -> Column:
    return F.coalesce(F.array_max(kept(xs, mask)), F.lit(0.0))


def effective_length(mask: Column, response_length: Column) -> Column:
    return F.coalesce(F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x), response_length.cast("long"))


def response_length(mask: Column) -> Column:
    """From the first 1 to the end; 0 without any."""
    at = F.array_position(mask, 1)
    return F.when(at == 0, F.lit(0).cast("long")).otherwise(F.size(mask) - at + 1)


def approx_kl(logp: Column, base: Column, kind: str, ratio: Column | None = None) -> Column:
    """k1, k2, k3 or low_var_kl (k3 clamped to [-10, 10], after any importance factor)."""
    delta = F.zip_with(logp, base, lambda a, b: a - b)
    each = {"k1": lambda d: d, "k2": lambda d: d * d / 2, "k3": lambda d: F.exp(-d) - 1 + d, "low_var_kl": lambda d: F.exp(-d) - 1 + d}[kind]
    out = F.transform(delta, each)
    if ratio is not None:
        out = F.zip_with(out, ratio, lambda k, r: k * r)
    return F.transform(out, lambda k: clamp(k, -10.0, 10.0)) if kind == "low_var_kl" else out


def policy_loss(kl: Column, advantage: Column, eps_low: float, eps_high: float, dual: float | None = None) -> tuple[Column, Column]:
    """Clipped loss of each token and whether clipping won; `dual`, over 1, bounds the loss where the advantage is negative."""
    if dual is not None and dual <= 1:
        raise ValueError("the dual bound must exceed 1")

    def loss(k: Column, a: Column) -> Column:
        r = F.exp(-k)
        worst = F.greatest(-r * a, -clamp(r, 1 - eps_low, 1 + eps_high) * a)
        return F.when(a < 0, F.least(-dual * a, worst)).otherwise(worst) if dual is not None else worst

    def clipped(k: Column, a: Column) -> Column:
        r = F.exp(-k)
        return F.when(-clamp(r, 1 - eps_low, 1 + eps_high) * a > -r * a, 1.0).otherwise(0.0)

    return F.zip_with(kl, advantage, loss), F.zip_with(kl, advantage, clipped)


def cispo_loss(kl: Column, logp: Column, advantage: Column, eps_low: float, eps_high: float) -> Column:
    weight = F.transform(kl, lambda k: clamp(F.exp(-k), 1 - eps_low, 1 + eps_high))
    return F.zip_with(F.zip_with(weight, advantage, lambda w, a: -w * a), logp, lambda x, p: x * p)


def sequence_kl(logp: Column, old: Column, mask: Column) -> Column:
    return masked_mean(F.zip_with(old, logp, lambda o, p: o - p), mask)


def sequence_kl_tokens(logp: Column, old: Column, mask: Column) -> Column:
    """The sequence's mean, at every token."""
    return F.array_repeat(sequence_kl(logp, old, mask), F.size(logp))


def off_policy_mask(logp: Column, old: Column, mask: Column, advantage: Column, delta: float) -> Column:
    far = sequence_kl(logp, old, mask) > delta
    return F.transform(advantage, lambda a: F.when((a < 0) & far, 0.0).otherwise(1.0))


def broadcast_reward(reward: Column, like: Column) -> Column:
    return F.array_repeat(reward, F.size(like))


def discounted(rewards: Column, gamma: float, chunk: int = 128) -> Column:
    """Return of each token: its reward and the discounted rest.

    Folded from the end within chunks, one number carried between them, so the cost grows with the length and not with its
    square."""

    def folded(part: Column) -> Column:
        return F.aggregate(F.reverse(part), F.array().cast("array<double>"), lambda acc, r: F.concat(F.array(r + gamma * F.coalesce(F.get(acc, F.lit(0)), F.lit(0.0))), acc))

    def joined(local: Column) -> Column:
        carried = F.aggregate(F.reverse(local), F.array(F.lit(0.0)), lambda acc, x: F.concat(F.array(F.coalesce(F.get(x, F.lit(0)), F.lit(0.0)) + F.pow(F.lit(gamma), F.size(x)) * acc[0]), acc))
        after = F.slice(carried, F.lit(2), F.size(local))
        return F.flatten(F.zip_with(local, after, lambda x, c: F.transform(x, lambda r, i: r + F.pow(F.lit(gamma), F.size(x) - i) * c)))

    starts = F.sequence(F.lit(0), F.greatest(F.size(rewards) - 1, F.lit(0)), F.lit(chunk))
    local = F.transform(starts, lambda at: folded(F.slice(rewards, at + 1, F.lit(chunk))))
    return F.when(rewards.isNotNull(), F.transform(F.array(local), joined)[0])  # bound once


def gae(rewards: Column, values: Column, gamma: float, lam: float, chunk: int = 128) -> Column:
    """Generalised advantages; nothing follows the last token. The size of the chunks changes the cost alone."""
    ahead = F.concat(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0.0)))
    delta = F.zip_with(F.zip_with(rewards, ahead, lambda r, v: r + gamma * v), values, lambda x, v: x - v)
    return discounted(delta, gamma * lam, chunk)


def shaped_returns(reward: Column, kl: Column, mask: Column, beta: float, gamma: float) -> Column:
    """-beta * kl, the reward at the last unmasked token, discounted. A row without such a token is an error."""
    last = F.size(mask) - F.array_position(F.reverse(mask), 1.0)
    last = F.when(F.array_position(mask, 1.0) > 0, last).otherwise(F.raise_error(F.lit("every token is masked")).cast("long"))
    step = F.transform(times(kl, mask), lambda k, i: -beta * k + F.when(i == last, reward).otherwise(0.0))
    return discounted(step, gamma)


def baseline_advantages(reward: Column, kl: Column, beta: float) -> Column:
    return F.transform(kl, lambda k: reward - beta * k)


def distilled(advantage: Column, student: Column, teacher: Column, weight: float) -> Column:
    same = (F.size(student) == F.size(teacher)) & (F.size(student) == F.size(advantage))
    gap = F.zip_with(student, teacher, lambda s, t: s - t)
    return F.when(same, F.zip_with(advantage, gap, lambda a, g: a - weight * g)).otherwise(F.raise_error(F.lit("lengths differ")).cast("array<double>"))


def truncated_is(train: Column, rollout: Column, low: float, high: float) -> Column:
    return F.transform(F.zip_with(train, rollout, lambda t, r: F.exp(t - r)), lambda w: clamp(w, low, high))


def icepop(train: Column, rollout: Column, low: float, high: float) -> Column:
    return F.transform(F.zip_with(train, rollout, lambda t, r: F.exp(t - r)), lambda w: F.when((w >= low) & (w <= high), w).otherwise(0.0))


def importance_weights(train: Column, rollout: Column, mask: Column, level: str = "token", mode: str = "truncate", low: float = 0.0, high: float = 2.0) -> tuple[Column, Column]:
    """Weights and the mask that follows: by token, sequence (sum) or geometric (mean) log-ratio within +-20;
    truncate and clip bound the weights, mask leaves them and drops tokens beyond the bounds."""
    ratio = F.zip_with(train, rollout, lambda t, r: t - r)
    if level != "token":
        one = masked_sum(ratio, mask) if level == "sequence" else masked_mean(ratio, mask)
        ratio = F.array_repeat(one, F.size(train))
    w = F.transform(ratio, lambda d: F.exp(clamp(d, -20.0, 20.0)))
    if mode == "mask":
        return w, F.zip_with(w, mask, lambda x, m: F.when((x >= low) & (x <= high), m).otherwise(0.0))
    return times(F.transform(w, lambda x: clamp(x, 0.0 if mode == "truncate" else low, high)), mask), mask


def vetoed(log_ratio: Column, mask: Column, threshold: float) -> Column:
    """Whether any unmasked token is less likely than `threshold` times."""
    import math

    return F.exists(kept(log_ratio, mask), lambda d: d < math.log(threshold))


def mismatch(train: Column, rollout: Column, mask: Column) -> dict[str, Column]:
    d = F.zip_with(train, rollout, lambda t, r: t - r)
    safe = F.transform(d, lambda x: clamp(x, -20.0, 20.0))
    mine, theirs = -masked_mean(train, mask), -masked_mean(rollout, mask)
    return {
        "train_log_ppl": mine,
        "rollout_log_ppl": theirs,
        "train_ppl": F.exp(mine),
        "rollout_ppl": F.exp(theirs),
        "kl": -masked_mean(d, mask),
        "k3": masked_mean(F.transform(d, lambda x: F.exp(x) - x - 1), mask),
        "log_ppl_diff": theirs - mine,
        "log_ppl_abs_diff": F.abs(theirs - mine),
        "ppl_ratio": F.exp(theirs - mine),
        "chi2_token": masked_mean(F.transform(safe, lambda x: F.exp(2 * x)), mask) - 1,
        "chi2_sequence": F.exp(2 * clamp(masked_sum(d, mask), -20.0, 20.0)) - 1,
    }


def value_loss(values: Column, old: Column, returns: Column, clip: float) -> tuple[Column, Column]:
    near = F.zip_with(values, old, lambda v, o: o + clamp(v - o, -clip, clip))
    square = lambda xs: F.zip_with(xs, returns, lambda x, r: (x - r) * (x - r))
    return F.zip_with(square(near), square(values), lambda a, b: F.greatest(a, b)), F.zip_with(values, old, lambda v, o: F.when(F.abs(v - o) > clip, 1.0).otherwise(0.0))


def merge_spans(ids: Column, offsets: Column, more_ids: Column, more_offsets: Column) -> tuple[Column, Column]:
    """Two ragged arrays (values and offsets from 0) one after the other."""
    last = F.element_at(offsets, -1)
    return F.concat(ids, more_ids), F.concat(offsets, F.transform(F.slice(more_offsets, F.lit(2), F.size(more_offsets) - 1), lambda x: x + last))


def pad_spans(offsets: Column, tokens: Column) -> Column:
    missing = F.greatest(tokens + 1 - F.size(offsets), F.lit(0))
    return F.concat(offsets, F.array_repeat(F.element_at(offsets, -1), missing))


def sublist_positions(xs: Column, part: Column) -> Column:
    """Where (from 0) `part` occurs in `xs`."""

    def found(both: Column) -> Column:
        x, p = both["x"], both["p"]
        starts = F.when(F.size(x) >= F.size(p), F.sequence(F.lit(0), F.size(x) - F.size(p))).otherwise(F.array().cast("array<int>"))
        return F.filter(starts, lambda i: (F.get(x, i) == F.get(p, F.lit(0))) & (F.slice(x, i + 1, F.size(p)) == p))

    return F.transform(F.array(F.struct(xs.alias("x"), part.alias("p"))), found)[0]  # bound once


def common_prefix(a: Column, b: Column) -> Column:
    def shared(both: Column) -> Column:
        x, y = both["x"], both["y"]
        same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))  # the shorter one is filled up with nulls
        n = F.least(F.size(x), F.size(y))
        at = F.array_position(F.slice(same, F.lit(1), n), False)
        return F.when(at == 0, n).otherwise(at.cast("int") - 1)

    return F.transform(F.array(F.struct(a.alias("x"), b.alias("y"))), shared)[0]  # bound once
