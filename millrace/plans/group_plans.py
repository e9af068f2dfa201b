"""Group filters, normalisation, pass rates and reward statistics over line items as samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import conversion as V
from ..operators import groups as G
from ..operators.ranking import with_quantiles
from ..operators import metrics as M
from .base import SAMPLES, Registry, r6, samples, table

R = Registry()
KS = [1, 2, 4, 5, 8, 10]


def by_group():
    return Window.partitionBy("group_index")


@R.add(
    f"""WITH {SAMPLES}, k AS (SELECT group_index FROM samples GROUP BY 1 HAVING coalesce(stddev_samp(score) > 1e-6, false)),
n AS (SELECT *, (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-6) AS v FROM samples SEMI JOIN k USING (group_index) WINDOW w AS (PARTITION BY group_index))
SELECT source_name, count(*) AS "count", round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, round(min(v),6) AS min, round(max(v),6) AS max FROM n GROUP BY 1"""
)
def group_norm_reward(spark, sf):
    df = G.varied_groups(samples(spark, sf), "group_index", "score").withColumn("v", G.normalised(F.col("score"), by_group()))
    return df.groupBy("source_name").agg(F.count("*").alias("count"), r6(F.avg("v"), "mean"), r6(F.stddev_pop("v"), "std"), r6(F.min("v"), "min"), r6(F.max("v"), "max"))


@R.add(f"WITH {SAMPLES} SELECT source_name, count(*) AS n FROM samples WHERE group_index IN (SELECT group_index FROM samples GROUP BY 1 HAVING stddev_samp(reward) > 1e-6) GROUP BY 1")
def pf3_varied_groups(spark, sf):
    return G.varied_groups(samples(spark, sf), "group_index", "reward").groupBy("source_name").agg(F.count("*").alias("n"))


@R.add(f"WITH {SAMPLES}, g AS (SELECT group_index, coalesce(stddev_samp(reward)>1e-6,false) AS varied, min(group_index*7%1000) AS arrival FROM samples GROUP BY 1) SELECT group_index, varied, (row_number() OVER (ORDER BY varied DESC, arrival, group_index))::INT AS rank FROM g QUALIFY rank <= 500")
def pf4_filled_groups(spark, sf):
    df = samples(spark, sf).withColumn("arrival", F.col("group_index") * 7 % 1000)
    return G.filled_groups(df, "group_index", "reward", "arrival", 500)


@R.add(f"WITH {SAMPLES}, g AS (SELECT min(score) AS lo, max(score) AS hi FROM samples GROUP BY group_index) SELECT 'zero_std_' || printf('%.1f', lo) AS reason, count(*) AS groups FROM g WHERE lo=hi GROUP BY 1")
def ag8_zero_variance_groups(spark, sf):
    return G.drop_reasons(samples(spark, sf), "group_index", "score")


@R.add(f"WITH {SAMPLES} SELECT status, count(*) AS n, round(count(*)/sum(count(*)) OVER (),6) AS fraction FROM samples GROUP BY 1")
def ag5_status_fractions(spark, sf):
    return M.status_shares(samples(spark, sf), "status").select("status", "n", r6(F.col("fraction"), "fraction"))


@R.add(f"WITH {SAMPLES} SELECT group_index, index, round(score, 1) AS score, round((score - avg(score) OVER w)/(stddev_samp(score) OVER w + 1e-6),6) AS advantage FROM samples WINDOW w AS (PARTITION BY group_index)")
def td4_normalised_by_group(spark, sf):
    return samples(spark, sf).select("group_index", "index", F.round("score", 1).alias("score"), r6(G.normalised(F.col("score"), by_group()), "advantage"))


@R.add(
    f"""WITH {SAMPLES}, v AS (SELECT *, CASE WHEN score BETWEEN 0 AND 1 THEN score END AS ok FROM samples),
w AS (SELECT *, avg(ok) OVER g AS m, stddev_pop(ok) OVER g AS s, max(ok) OVER g AS t FROM v WINDOW g AS (PARTITION BY group_index))
SELECT group_index, round(sum(CASE WHEN t=0 THEN score WHEN s=0 THEN 0 ELSE (score-m)/s END),6) AS total, count(*) AS n FROM w GROUP BY 1"""
)
def td3_buffer_normalised(spark, sf):
    df = samples(spark, sf).withColumn("v", G.buffer_normalised(F.col("score"), by_group()))
    return df.groupBy("group_index").agg(r6(F.sum("v"), "total"), F.count("*").alias("n"))


@R.add(
    f"""WITH {SAMPLES}, g AS (SELECT count(*) AS n, sum(reward)::INT AS c FROM samples GROUP BY group_index), k AS (SELECT unnest([1,2,4,5,8,10]) AS k),
e AS (SELECT k, CASE WHEN n-c<k THEN 1.0 WHEN c=0 THEN 0.0 ELSE 1-(SELECT product(1-k/i) FROM (SELECT unnest(generate_series(n-c+1,n)) AS i)) END AS p FROM g, k WHERE n>=k)
SELECT k::INT AS k, round(avg(p),6) AS pass_at_k, count(*) AS groups FROM e GROUP BY 1"""
)
def ag2_pass_at_k(spark, sf):
    return G.pass_rates(samples(spark, sf), "group_index", "reward", KS).select("k", r6(F.col("pass_at_k"), "pass_at_k"), "groups")


STATS = "count(score) AS \"count\", round(avg(score),6) AS mean, round(stddev_pop(score),6) AS std, min(score) AS min, max(score) AS max, round(quantile_cont(score,0.1),6) AS p10, round(quantile_cont(score,0.5),6) AS p50, round(quantile_cont(score,0.9),6) AS p90, round(avg((score=1)::INT),6) AS pass_rate"


@R.add(f"WITH {SAMPLES} SELECT coalesce(source_name,'all') AS source, {STATS} FROM samples GROUP BY GROUPING SETS ((source_name),())")
def ag7_reward_statistics(spark, sf):
    df = samples(spark, sf)
    g = G.reward_statistics(df, ["source_name"], "score").unionByName(G.reward_statistics(df, [], "score").withColumn("source_name", F.lit(None).cast("string")))
    return g.select(F.coalesce("source_name", F.lit("all")).alias("source"), "count", *[r6(F.col(c), c) for c in ("mean", "std")], "min", "max", *[r6(F.col(c), c) for c in ("p10", "p50", "p90", "pass_rate")])


@R.add(
    f"""WITH {SAMPLES} SELECT round(avg(response_length),6) AS mean, round(median(response_length),6) AS median, max(response_length) AS max, min(response_length) AS min, round(quantile_cont(response_length,0.9),6) AS p90,
round(quantile_cont(response_length,0.95),6) AS p95, round(quantile_cont(response_length,0.99),6) AS p99, round(avg((status='truncated')::INT),6) AS truncated FROM samples"""
)
def ag4_rollout_summary(spark, sf):
    n = F.col("response_length")
    shares = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    g = with_quantiles(samples(spark, sf), [], "response_length", shares, r6(F.avg(n), "mean"), F.max(n).alias("max"), F.min(n).alias("min"), r6(F.avg((F.col("status") == "truncated").cast("int")), "truncated"))
    return g.select("mean", "max", "min", "truncated", *[r6(F.col(c), c) for c in shares])


@R.add(
    """WITH t AS (SELECT o_orderpriority AS arm, month(o_orderdate) AS seed, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
g AS (SELECT arm, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM t GROUP BY 1), q AS (SELECT [12.706,4.303,3.182,2.776,2.571,2.447,2.365,2.306,2.262,2.228,2.201,2.179,2.16,2.145,2.131,2.12,2.11,2.101,2.093,2.086,2.08,2.074,2.069,2.064,2.06,2.056,2.052,2.048,2.045] AS t)
SELECT arm, n, round(mean,4) AS mean, round(sd,4) AS sd, round(mean - q.t[n-1]*sd/sqrt(n),4) AS low, round(mean + q.t[n-1]*sd/sqrt(n),4) AS high FROM g, q"""
)
def ag29_confidence_intervals(spark, sf):
    runs = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.month("o_orderdate").alias("seed")).agg(F.avg("o_totalprice").alias("v"))
    g = G.estimates(runs, ["arm"], "v")
    return g.select("arm", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "low", "high")])


@R.add(f"WITH {SAMPLES} SELECT source_name AS category, count(*) AS n, round(count(*)/sum(count(*)) OVER (),6) AS share FROM samples GROUP BY 1")
def ag12_category_shares(spark, sf):
    return M.status_shares(samples(spark, sf).withColumnRenamed("source_name", "category"), "category").select("category", "n", r6(F.col("fraction"), "share"))


@R.add(f"WITH {SAMPLES}, m AS (SELECT max(response_length) AS m FROM samples) SELECT count(*) AS n, sum(response_length) AS tokens, round(sum(response_length)/60.0/8,6) AS tokens_per_gpu_per_sec, round(max(response_length)/60.0,6) AS longest_per_sec, round(avg(price) FILTER (response_length=m),4) AS longest_wait FROM samples, m")
def ag13_throughput(spark, sf):
    n = F.col("response_length")
    by = samples(spark, sf).groupBy(n).agg(F.count("*").alias("rows"), F.sum("price").alias("waits"))
    return by.agg(F.sum("rows").alias("n"), F.sum(n * F.col("rows")).alias("tokens"), r6(F.sum(n * F.col("rows")) / 60.0 / 8, "tokens_per_gpu_per_sec"), r6(F.max(n) / 60.0, "longest_per_sec"), F.round(F.max_by(F.col("waits") / F.col("rows"), n), 4).alias("longest_wait"))


@R.add(f"WITH {SAMPLES}, g AS (SELECT count(*) AS size, avg(score) AS r FROM samples GROUP BY group_index) SELECT sum(size)::BIGINT AS samples, count(*) AS groups, round(avg(size),6) AS mean_size, round(avg(r),6) AS mean_reward FROM g")
def ag15_buffer_meta(spark, sf):
    g = samples(spark, sf).groupBy("group_index").agg(F.count("*").alias("size"), F.avg("score").alias("r"))
    return g.agg(F.sum("size").alias("samples"), F.count("*").alias("groups"), r6(F.avg("size"), "mean_size"), r6(F.avg("r"), "mean_reward"))


@R.add(f"WITH {SAMPLES}, m AS (SELECT max(response_length) AS m FROM samples) SELECT least(ceil(response_length*4.0/m),4)::INT AS quartile, count(*) AS n FROM samples, m GROUP BY 1")
def ag22_length_quartiles(spark, sf):
    df = samples(spark, sf)
    top = df.agg(F.max("response_length").alias("m"))  # one row
    return df.join(F.broadcast(top)).groupBy(F.least(F.ceil(F.col("response_length") * 4.0 / F.col("m")), F.lit(4)).cast("int").alias("quartile")).agg(F.count("*").alias("n"))


@R.add(f"WITH {SAMPLES} SELECT source_name, round(sum(response_length*reward)/greatest(sum(response_length),1),6) AS token_mean, round(sum(response_length*reward/greatest(response_length,1))/count(*),6) AS sample_mean FROM samples GROUP BY 1")
def ag17_token_and_sample_means(spark, sf):
    n, r = F.col("response_length"), F.col("reward")
    return samples(spark, sf).groupBy("source_name").agg(r6(F.sum(n * r) / F.greatest(F.sum(n), F.lit(1)), "token_mean"), r6(F.sum(n * r / F.greatest(n, F.lit(1))) / F.count("*"), "sample_mean"))


@R.add(
    """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, count(*) AS "count", round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, round(sqrt(sum(v*v)),5) AS l2, round(sqrt(avg(v*v)),6) AS rms,
round(max(abs(v)),6) AS max_abs, round(quantile_cont(v,0.1),6) AS p10, round(quantile_cont(v,0.5),6) AS p50, round(quantile_cont(v,0.9),6) AS p90, round(quantile_cont(v,0.99),6) AS p99, round(avg((v<0)::INT),6) AS negative_fraction FROM x GROUP BY 1"""
)
def ag25_distribution(spark, sf):
    x = table(spark, sf, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("v"))
    g = M.value_distribution(x, ["label"], "v")
    return g.select("label", "count", *[F.round(c, 5).alias(c) if c == "l2" else r6(F.col(c), c) for c in g.columns if c not in ("label", "count")])


@R.add("WITH x AS (SELECT vec_id, len(embedding) AS n, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1)-1 AS i FROM embeddings) SELECT least(9, i*10//n)::INT AS bin, count(*) AS n, round(avg(v),6) AS mean FROM x GROUP BY 1")
def ag26_position_bins(spark, sf):
    x = table(spark, sf, "embeddings").select(F.size("embedding").alias("len"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    return x.groupBy(M.position_bin(F.col("i"), F.col("len")).alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("v"), "mean"))


@R.add(f"WITH {SAMPLES} SELECT group_index, index, sum(response_length) OVER (PARTITION BY group_index) AS rollout_tokens, sum(response_length) OVER (PARTITION BY group_index ORDER BY index RANGE UNBOUNDED PRECEDING) AS so_far FROM samples")
def ag36_rollout_sums(spark, sf):
    n = F.sum("response_length")
    return samples(spark, sf).select("group_index", "index", n.over(by_group()).alias("rollout_tokens"), n.over(by_group().orderBy("index").rangeBetween(Window.unboundedPreceding, 0)).alias("so_far"))


@R.add("SELECT o_orderpriority AS task, round(avg(o_totalprice),4) AS median_mean, round(quantile_cont(o_totalprice,0.5),4) AS median, round(quantile_cont(o_totalprice,0.75)-quantile_cont(o_totalprice,0.25),4) AS iqr, count(*) AS n FROM orders GROUP BY 1")
def ag35_median_and_iqr(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "task")
    g = o.groupBy("task").agg(F.avg("o_totalprice").alias("median_mean"), F.count("*").alias("n")).join(M.median_and_iqr(o, ["task"], "o_totalprice"), "task")
    return g.select("task", *[F.round(c, 4).alias(c) for c in ("median_mean", "median", "iqr")], "n")


@R.add("WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN NULL ELSE o_orderkey*2 END AS rollout_id FROM orders), u AS (SELECT DISTINCT rollout_id AS v FROM o WHERE rollout_id IS NOT NULL), f AS (SELECT r AS v, row_number() OVER (ORDER BY r) AS k FROM range((SELECT 4*max(o_orderkey) FROM orders)) t(r) WHERE r NOT IN (SELECT v FROM u)), m AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM o WHERE rollout_id IS NULL) SELECT o_orderkey, rollout_id FROM o WHERE rollout_id IS NOT NULL UNION ALL SELECT o_orderkey, v FROM m JOIN f USING (k)")
def td2_filled_rollout_ids(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") * 2).alias("rollout_id"))
    return G.filled_ids(o, "o_orderkey", "rollout_id")


@R.add(
    """WITH p AS (SELECT o_orderkey, o_totalprice/1000 AS reward, row_number() OVER (ORDER BY o_orderkey)-1 AS place, count(*) OVER () AS n FROM orders), b AS (SELECT * FROM p WHERE place < n//4*4),
blocks AS (SELECT o_orderkey, (reward-avg(reward) OVER w)/(stddev_samp(reward) OVER w+1e-6) AS v FROM b WINDOW w AS (PARTITION BY place//4)), whole AS (SELECT o_orderkey, reward-avg(reward) OVER () AS v FROM p)
SELECT o_orderkey, round(blocks.v,6) AS blocks, round(whole.v,6) AS whole FROM blocks JOIN whole USING (o_orderkey)"""
)
def td1_block_rewards(spark, sf):
    """Orders in blocks of four that fill the batch, and all of them as one group, since their number doesn't fit, without a deviation."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("reward"))
    n = o.count()
    first = o.orderBy("o_orderkey").limit(n // 4 * 4)
    blocks = V.block_rewards(first, "o_orderkey", "reward", "grpo", 4, n // 4, name="blocks").drop("reward")
    whole = V.block_rewards(o, "o_orderkey", "reward", "reinforce_plus_plus_baseline", 4, n, name="whole").drop("reward")
    return blocks.join(whole, "o_orderkey").select("o_orderkey", r6(F.col("blocks"), "blocks"), r6(F.col("whole"), "whole"))


@R.add(
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey%3<>0 THEN o_custkey*2 END AS rollout_id, (o_orderkey%6)::INT AS n, o_orderstatus, o_totalprice, o_orderkey%4=0 AS gone, o_orderkey%2=0 AS has, o_orderkey%10=1 AS told FROM orders),
u AS (SELECT DISTINCT rollout_id AS v FROM o WHERE rollout_id IS NOT NULL), free AS (SELECT r AS v, row_number() OVER (ORDER BY r) AS k FROM range((SELECT 2*max(o_custkey)+2*count(*) FROM orders)) t(r) WHERE r NOT IN (SELECT v FROM u)),
m AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM o WHERE rollout_id IS NULL), f AS (SELECT o.*, coalesce(o.rollout_id, free.v) AS rid FROM o LEFT JOIN m USING (o_orderkey) LEFT JOIN free ON free.k=m.k),
g AS (SELECT *, CASE WHEN gone THEN 0 WHEN has THEN n//2 ELSE n END AS taken FROM f)
SELECT o_orderkey, rid AS rollout_id, taken::BIGINT AS taken, (o_orderstatus='F')::INT AS truncated, sum(taken) OVER (PARTITION BY rid)::BIGINT AS rollout_mask_sum, round(CASE WHEN told THEN 7.5 ELSE o_totalprice END,2) AS raw_reward FROM g"""
)
def td2_training_columns(spark, sf):
    """Orders as samples of customers' rollouts: every third has no id, every second its own mask, every fourth is removed."""
    k, n = F.col("o_orderkey"), (F.col("o_orderkey") % 6).cast("int")
    half = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= F.floor(n / 2)).cast("int"))
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 3 != 0, F.col("o_custkey") * 2).alias("rollout_id"), n.alias("response_length"), F.when(k % 2 == 0, F.slice(half, F.lit(1), n)).alias("loss_mask"), (k % 4 == 0).alias("remove_sample"),
        F.when(F.col("o_orderstatus") == "F", "truncated").otherwise("completed").alias("status"), F.when(k % 10 == 1, F.create_map(F.lit("raw_reward"), F.lit("7.5"))).alias("metadata"), F.col("o_totalprice").alias("reward"),
    )
    taken = F.aggregate("loss_mask", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return V.training_columns(o, "o_orderkey").select("o_orderkey", "rollout_id", taken.alias("taken"), "truncated", "rollout_mask_sum", F.round("raw_reward", 2).alias("raw_reward"))
