"""Token-array operators over the embeddings, each against a relational formulation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators.conversion import batch_normalised
from .base import TOKENS, Registry, r6, tokens

R = Registry()


def digest(df: DataFrame, xs, *more) -> DataFrame:
    """Sum, extremes and a position-weighted sum of an array tell arrays apart."""
    return df.select(
        "vec_id", r6(T.total(xs), "total"), r6(F.array_min(xs), "least"), r6(F.array_max(xs), "most"), r6(T.total(F.transform(xs, lambda x, i: x * (i + 1))), "weighted"), *more
    )


def digested(value: str, more: str = "", source: str = "tok") -> str:
    return f"SELECT vec_id, round(sum(v),6) AS total, round(min(v),6) AS least, round(max(v),6) AS most, round(sum(v*(i+1)),6) AS weighted{more} FROM (SELECT *, {value} AS v FROM {source}) GROUP BY vec_id"


CLIP = "greatest(least({0},{2}),{1})"


@R.add(f"WITH {TOKENS} {digested('logp-base')}")
def ta1_approx_kl_k1(spark, sf):
    return digest(tokens(spark, sf), T.approx_kl(F.col("logp"), F.col("base"), "k1"))


@R.add(f"WITH {TOKENS} {digested('(logp-base)*(logp-base)/2')}")
def ta1_approx_kl_k2(spark, sf):
    return digest(tokens(spark, sf), T.approx_kl(F.col("logp"), F.col("base"), "k2"))


@R.add(f"WITH {TOKENS} {digested('greatest(least((exp(-(logp-base))-1+(logp-base))*exp(logp-old),10.0),-10.0)')}")
def ta1_approx_kl_low_var(spark, sf):
    ratio = F.zip_with("logp", "old", lambda a, b: F.exp(a - b))
    return digest(tokens(spark, sf), T.approx_kl(F.col("logp"), F.col("base"), "low_var_kl", ratio))


@R.add(
    f"WITH {TOKENS}, k AS (SELECT *, exp(-(old-logp)) AS r, greatest(least(exp(-(old-logp)),1.28),0.8) AS c FROM tok) "
    + digested("CASE WHEN adv<0 THEN least(-3.0*adv, greatest(-r*adv,-c*adv)) ELSE greatest(-r*adv,-c*adv) END", ", round(avg(CASE WHEN -c*adv > -r*adv THEN 1.0 ELSE 0.0 END),6) AS clip_fraction", "k")
)
def ta2_policy_loss(spark, sf):
    kl = F.zip_with("old", "logp", lambda o, p: o - p)
    loss, clipped = T.policy_loss(kl, F.col("adv"), 0.2, 0.28, 3.0)
    return digest(tokens(spark, sf), loss, r6(T.total(clipped) / F.size("x"), "clip_fraction"))


@R.add(f"WITH {TOKENS} {digested('-greatest(least(exp(-(old-logp)),1.28),0.8)*adv*logp')}")
def ta3_cispo_loss(spark, sf):
    kl = F.zip_with("old", "logp", lambda o, p: o - p)
    return digest(tokens(spark, sf), T.cispo_loss(kl, F.col("logp"), F.col("adv"), 0.2, 0.28))


SEQ = f"WITH {TOKENS}, s AS (SELECT vec_id AS v2, sum((old-logp)*mask)/greatest(sum(mask),1.0) AS kl FROM tok GROUP BY vec_id), j AS (SELECT * FROM tok JOIN s ON vec_id=v2) "


@R.add(SEQ + digested("kl", source="j"))
def ta4_gspo_kl(spark, sf):
    return digest(tokens(spark, sf), T.sequence_kl_tokens(F.col("logp"), F.col("old"), F.col("mask")))


@R.add(SEQ + digested("CASE WHEN adv<0 AND kl>0.01 THEN 0.0 ELSE 1.0 END", source="j"))
def ta5_off_policy_mask(spark, sf):
    return digest(tokens(spark, sf), T.off_policy_mask(F.col("logp"), F.col("old"), F.col("mask"), F.col("adv"), 0.01))


@R.add(f"WITH {TOKENS} {digested('reward')}")
def ta6_grpo_returns(spark, sf):
    return digest(tokens(spark, sf), T.broadcast_reward(F.col("reward"), F.col("x")))


@R.add(
    f"WITH {TOKENS}, z AS (SELECT vec_id, max(i) FILTER (mask=1) AS last FROM tok GROUP BY vec_id), q AS (SELECT t.vec_id, i, -0.1*(logp-base)*mask + CASE WHEN i=last THEN reward ELSE 0 END AS r FROM tok t JOIN z USING (vec_id)), "
    + "d AS (SELECT a.vec_id, a.i, sum(b.r*pow(0.99,b.i-a.i)) AS ret FROM q a JOIN q b ON a.vec_id=b.vec_id AND b.i>=a.i GROUP BY ALL) "
    + digested("ret", source="d")
)
def ta7_reinforce_plus_plus_returns(spark, sf):
    kl = F.zip_with("logp", "base", lambda a, b: a - b)
    return digest(tokens(spark, sf), T.shaped_returns(F.col("reward"), kl, F.col("mask"), 0.1, 0.99))


@R.add(f"WITH {TOKENS} {digested('reward-0.1*(logp-base)')}")
def ta8_reinforce_baseline(spark, sf):
    kl = F.zip_with("logp", "base", lambda a, b: a - b)
    return digest(tokens(spark, sf), T.baseline_advantages(F.col("reward"), kl, 0.1))


@R.add(f"WITH {TOKENS} {digested('adv-0.5*(logp-base)')}")
def ta10_distillation(spark, sf):
    return digest(tokens(spark, sf), T.distilled(F.col("adv"), F.col("logp"), F.col("base"), 0.5))


@R.add(
    f"WITH {TOKENS}, g AS (SELECT sum(adv*mask)/sum(mask) AS mean, sum(mask) AS n, sum(adv*adv*mask)/sum(mask) AS sq FROM tok), w AS (SELECT tok.*, (adv-mean)/sqrt((sq-mean*mean)*n/(n-1)+1e-8) AS v0 FROM tok, g) "
    + digested("v0", source="w")
)
def ta11_masked_whitening(spark, sf):
    from ..functions.advantages import whitened

    return digest(whitened(tokens(spark, sf), "adv", "mask"), F.col("adv"))


@R.add(f"WITH {TOKENS} " + digested("greatest(least(exp(logp-old),1.02),0.5)", ", round(avg(CASE WHEN exp(logp-old)>1.02 OR exp(logp-old)<0.5 THEN 1.0 ELSE 0.0 END),6) AS clip_fraction"))
def ta12_truncated_importance(spark, sf):
    w = F.zip_with("logp", "old", lambda a, b: F.exp(a - b))
    cut = T.total(F.transform(w, lambda x: F.when((x > 1.02) | (x < 0.5), 1.0).otherwise(0.0))) / F.size("x")
    return digest(tokens(spark, sf), T.truncated_is(F.col("logp"), F.col("old"), 0.5, 1.02), r6(cut, "clip_fraction"))


@R.add(f"WITH {TOKENS} " + digested("CASE WHEN exp(logp-old) BETWEEN 0.98 AND 1.02 THEN exp(logp-old) ELSE 0.0 END"))
def ta13_icepop(spark, sf):
    return digest(tokens(spark, sf), T.icepop(F.col("logp"), F.col("old"), 0.98, 1.02))


@R.add(f"WITH {TOKENS}, s AS (SELECT vec_id AS v2, exp(greatest(least(sum((logp-old)*mask),20.0),-20.0)) AS w FROM tok GROUP BY vec_id), j AS (SELECT * FROM tok JOIN s ON vec_id=v2) " + digested("greatest(least(w,2.0),0.0)*mask", source="j"))
def ta14_sequence_weights(spark, sf):
    return digest(tokens(spark, sf), T.importance_weights(F.col("logp"), F.col("old"), F.col("mask"), "sequence", "truncate", high=2.0)[0])


@R.add(
    f"""WITH {TOKENS}, s AS (SELECT vec_id, exp(greatest(least(sum((logp-old)*mask),20.0),-20.0)) AS w, sum(mask) AS n FROM tok GROUP BY vec_id), t AS (SELECT *, least(w,2.0) AS v FROM s),
m AS (SELECT avg(v*n/greatest(n,1)) AS mean FROM t) SELECT vec_id, round(v*n/mean,6) AS normalised FROM t, m"""
)
def ta14_batch_normalised(spark, sf):
    """Weights of sequences over their mean in the batch, added up over each sequence's tokens."""
    t = tokens(spark, sf)
    w = t.select("vec_id", "mask", T.importance_weights(F.col("logp"), F.col("old"), F.col("mask"), "sequence", "truncate", high=2.0)[0].alias("w"))
    return batch_normalised(w, "w", "mask", "sequence").select("vec_id", r6(T.total(F.zip_with("w", "mask", lambda x, m: x * m)), "normalised"))


@R.add(f"WITH {TOKENS} SELECT vec_id, round(sum(x*mask),6) AS masked_sum, round(sum(x*mask)/greatest(sum(mask),1.0),6) AS masked_mean, round(coalesce(min(x) FILTER (mask>0),0.0),6) AS masked_min, round(coalesce(max(x) FILTER (mask>0),0.0),6) AS masked_max FROM tok GROUP BY vec_id")
def ta15_masked_reductions(spark, sf):
    x, m = F.col("x"), F.col("mask")
    return tokens(spark, sf).select("vec_id", r6(T.masked_sum(x, m), "masked_sum"), r6(T.masked_mean(x, m), "masked_mean"), r6(T.masked_min(x, m), "masked_min"), r6(T.masked_max(x, m), "masked_max"))


@R.add(f"WITH {TOKENS} " + digested("greatest(least(exp(logp-old),1.02),0.99)*mask"))
def ta20_clipped_weights(spark, sf):
    return digest(tokens(spark, sf), T.importance_weights(F.col("logp"), F.col("old"), F.col("mask"), "token", "clip", 0.99, 1.02)[0])


@R.add(f"WITH {TOKENS} " + digested("CASE WHEN exp(logp-old) BETWEEN 0.99 AND 1.02 THEN mask ELSE 0.0 END"))
def ta21_range_mask(spark, sf):
    return digest(tokens(spark, sf), T.importance_weights(F.col("logp"), F.col("old"), F.col("mask"), "token", "mask", 0.99, 1.02)[1])


@R.add(f"WITH {TOKENS} SELECT vec_id, coalesce(bool_or(logp-old < ln(0.9)) FILTER (mask>0), false) AS vetoed FROM tok GROUP BY vec_id")
def ta22_veto(spark, sf):
    d = F.zip_with("logp", "old", lambda a, b: a - b)
    return tokens(spark, sf).select("vec_id", T.vetoed(d, F.col("mask"), 0.9).alias("vetoed"))


@R.add(
    f"""WITH {TOKENS}, d AS (SELECT vec_id, greatest(sum(mask),1.0) AS n, sum(logp*mask) AS a, sum(old*mask) AS b, sum((logp-old)*mask) AS dd, sum((exp(logp-old)-(logp-old)-1)*mask) AS k,
 sum(exp(2*greatest(least(logp-old,20.0),-20.0))*mask) AS c FROM tok GROUP BY vec_id)
SELECT vec_id, round(-a/n,6) AS train_log_ppl, round(-b/n,6) AS rollout_log_ppl, round(exp(-a/n),6) AS train_ppl, round(exp(-b/n),6) AS rollout_ppl, round(-dd/n,6) AS kl, round(k/n,6) AS k3,
 round((a-b)/n,6) AS log_ppl_diff, round(abs((a-b)/n),6) AS log_ppl_abs_diff, round(exp((a-b)/n),6) AS ppl_ratio, round(c/n-1,6) AS chi2_token, round(exp(2*greatest(least(dd,20.0),-20.0))-1,6) AS chi2_sequence FROM d"""
)
def ta23_mismatch_metrics(spark, sf):
    return tokens(spark, sf).select("vec_id", *[r6(c, k) for k, c in T.mismatch(F.col("logp"), F.col("old"), F.col("mask")).items()])


@R.add(f"WITH {TOKENS} " + digested("greatest(pow(old+greatest(least(logp-old,0.02),-0.02)-base,2),pow(logp-base,2))", ", round(avg(CASE WHEN abs(logp-old)>0.02 THEN 1.0 ELSE 0.0 END),6) AS clip_fraction"))
def ta25_value_loss(spark, sf):
    loss, clipped = T.value_loss(F.col("logp"), F.col("old"), F.col("base"), 0.02)
    return digest(tokens(spark, sf), loss, r6(T.total(clipped) / F.size("x"), "clip_fraction"))


@R.add(f"WITH {TOKENS} SELECT vec_id, round(-sum(logp*mask)/greatest(sum(mask),1.0),6) AS loss FROM tok GROUP BY vec_id")
def ta26_sft_loss(spark, sf):
    return tokens(spark, sf).select("vec_id", r6(-T.masked_mean(F.col("logp"), F.col("mask")), "loss"))


@R.add(f"WITH {TOKENS}, p AS (SELECT vec_id, count(*) AS n, min(i) FILTER (x>0) AS first FROM tok GROUP BY vec_id) SELECT vec_id, coalesce(n-first,0)::BIGINT AS response_length FROM p")
def ta37_response_length(spark, sf):
    mask = F.transform("x", lambda x: F.when(x > 0, 1).otherwise(0))
    return tokens(spark, sf).select("vec_id", T.response_length(mask).alias("response_length"))


@R.add(f"WITH {TOKENS}, d AS (SELECT a.vec_id, a.i, sum(b.x*pow(0.95,b.i-a.i)) AS ret FROM tok a JOIN tok b ON a.vec_id=b.vec_id AND b.i>=a.i GROUP BY ALL) " + digested("ret", source="d"))
def wn10_discounted_returns(spark, sf):
    return digest(tokens(spark, sf), T.discounted(F.col("x"), 0.95))


@R.add(
    f"WITH {TOKENS}, e AS (SELECT vec_id, i, x+0.99*coalesce(lead(base) OVER (PARTITION BY vec_id ORDER BY i),0.0)-base AS dl FROM tok), d AS (SELECT a.vec_id, a.i, sum(b.dl*pow(0.99*0.95,b.i-a.i)) AS adv FROM e a JOIN e b ON a.vec_id=b.vec_id AND b.i>=a.i GROUP BY ALL) "
    + digested("adv", source="d")
)
def wn11_gae(spark, sf):
    return digest(tokens(spark, sf), T.gae(F.col("x"), F.col("base"), 0.99, 0.95))
