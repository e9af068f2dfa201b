"""Fields of samples and their summaries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import samples as P
from ..functions import tokens as T
from ..operators import metrics as M
from .base import SAMPLES, TOKENS, Registry, r6, samples, table, tokens

R = Registry()


@R.add("SELECT doc_id, 'user' AS role, md5(text) AS content FROM documents")
def pf1_prompt_messages(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.prompt_messages(F.col("text"))[0].alias("m")).select("doc_id", "m.role", F.md5("m.content").alias("content"))


@R.add("SELECT doc_id FROM documents WHERE len(regexp_extract_all(text,'[A-Za-z0-9_]+|[^A-Za-z0-9_]'))<=400")
def pf2_short_prompts(spark, sf):
    from ..functions.chat_masks import plain_pieces

    return table(spark, sf, "documents").filter(F.size(plain_pieces(F.col("text"))) <= 400).select("doc_id")


@R.add(f"WITH {SAMPLES} SELECT status AS reason, count(*) AS dropped FROM samples WHERE status IN ('truncated','aborted') GROUP BY 1")
def pf7_drops_by_reason(spark, sf):
    return samples(spark, sf).filter(F.col("status").isin("truncated", "aborted")).groupBy(F.col("status").alias("reason")).agg(F.count("*").alias("dropped"))


@R.add("SELECT event_id, CASE WHEN event_type='click' THEN value END AS reward FROM events")
def pf9_keyed_reward(spark, sf):
    return table(spark, sf, "events").select("event_id", P.keyed_reward(F.create_map("event_type", "value"), "click").alias("reward"))


@R.add("SELECT event_id, CASE WHEN event_id%3=0 THEN value WHEN event_id%3=1 THEN 0.5::DOUBLE END AS reward FROM events")
def pf10_task_reward(spark, sf):
    k = F.col("event_id") % 3
    return table(spark, sf, "events").select("event_id", P.task_reward(F.when(k == 0, F.col("value")).when(k == 1, float("nan")), F.when(k == 1, 0.5)).alias("reward"))


@R.add(f"WITH {SAMPLES} SELECT source_name AS task, count(*) AS n FROM samples WHERE source_name IN ('F') GROUP BY 1 UNION ALL SELECT 'default', count(*) FROM samples WHERE source_name NOT IN ('F')")
def jn6_teacher_routing(spark, sf):
    s = samples(spark, sf).withColumn("task", P.routed([F.lit(None).cast("string"), F.col("source_name"), F.col("status")], ["F", "G"], "default"))
    return s.groupBy("task").agg(F.count("*").alias("n"))


@R.add("SELECT vec_id, CASE WHEN vec_id%3=1 THEN ['loss_mask'] WHEN vec_id%3=2 THEN ['offsets'] ELSE []::VARCHAR[] END AS broken FROM embeddings")
def pf16_array_violations(spark, sf):
    e, n, k = F.col("embedding"), F.size("embedding"), F.col("vec_id") % 3
    mask = F.when(k == 1, F.slice(e, 1, 3)).otherwise(e)
    return table(spark, sf, "embeddings").select("vec_id", P.array_violations(mask, F.lit(None).cast("array<double>"), n, F.sequence(F.when(k == 2, 1).otherwise(0), n)).alias("broken"))


@R.add("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus)<>1")
def pf17_unequal_siblings(spark, sf):
    return M.unequal_siblings(table(spark, sf, "orders"), "o_custkey", "o_orderstatus")


@R.add(f"WITH {SAMPLES} SELECT group_index FROM samples GROUP BY 1 HAVING count(*)>=4")
def pf18_full_groups(spark, sf):
    return M.full_groups(samples(spark, sf), "group_index", 4)


@R.add("SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*)>=3 AND count(*) FILTER (WHERE trim(text)<>'')>=3")
def pf19_answered_groups(spark, sf):
    return M.full_groups(table(spark, sf, "conversations"), "conv_id", 3, "text")


@R.add("SELECT event_id, CASE WHEN event_id%2=0 THEN event_type ELSE 'math' END AS rm_type, 'x' AS kept FROM events")
def pf21_merged_metadata(spark, sf):
    base = F.create_map(F.lit("rm_type"), F.col("event_type"), F.lit("kept"), F.lit("x"))
    over = F.when(F.col("event_id") % 2 == 1, F.create_map(F.lit("rm_type"), F.lit("math")))
    return table(spark, sf, "events").select("event_id", P.merged_metadata(base, over).alias("m")).select("event_id", F.col("m")["rm_type"].alias("rm_type"), F.col("m")["kept"].alias("kept"))


@R.add("SELECT o_orderkey, (o_orderkey+1)%10=0 OR (o_orderkey+1)%25=0 OR o_orderkey=999 AS due FROM orders")
def pf23_periodic(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", P.periodic(F.col("o_orderkey"), 10, 25, 1000).alias("due"))


@R.add(f"WITH {TOKENS} SELECT vec_id, CASE WHEN vec_id%2=0 THEN 0 ELSE sum(mask) END::DOUBLE AS trained FROM tok GROUP BY 1")
def pf24_masked_partial(spark, sf):
    t = tokens(spark, sf)
    m = P.masked_partial(F.col("mask"), F.col("vec_id") % 2 == 0, F.size("mask"))
    return t.select("vec_id", T.total(m.cast("array<double>")).alias("trained"))


@R.add(f"WITH {SAMPLES} SELECT source_name, avg(response_length) AS mean, median(response_length) AS median, max(response_length) AS max, min(response_length) AS min FROM samples GROUP BY 1")
def ag1_statistics(spark, sf):
    return M.statistics(samples(spark, sf), ["source_name"], "response_length").drop("n")


@R.add(f"WITH {SAMPLES} SELECT source_name, round(avg(reward),6) AS mean, round(stddev_pop(reward),6) AS std, quantile_cont(reward,0.5) AS p50, round(avg((reward=1)::INT),6) AS pass_rate FROM samples GROUP BY 1")
def ag6_reward_statistics(spark, sf):
    from ..operators.groups import reward_statistics

    g = reward_statistics(samples(spark, sf), ["source_name"], "reward")
    return g.select("source_name", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"), "p50", r6(F.col("pass_rate"), "pass_rate"))


@R.add("SELECT l_returnflag, round(avg(l_discount/nullif(l_quantity,0)),9) AS mean_of_ratios, round(sum(l_discount)/sum(l_quantity),9) AS ratio_of_sums FROM lineitem GROUP BY 1")
def ag10_accept_rates(spark, sf):
    a, b = F.col("l_discount"), F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.try_divide(a, b)), 9).alias("mean_of_ratios"), F.round(F.try_divide(F.sum(a), F.sum(b)), 9).alias("ratio_of_sums"))


@R.add(f"WITH {SAMPLES} SELECT status, round(sum(score*response_length)/sum(response_length),6) AS token_mean, round(sum(score)/count(*),6) AS sample_mean FROM samples GROUP BY 1")
def ag19_merged_means(spark, sf):
    """Sums and counts of parts, which add up, then one division."""
    s = samples(spark, sf).groupBy("status", (F.col("index") % 4).alias("shard")).agg(F.sum(F.col("score") * F.col("response_length")).alias("ws"), F.sum("response_length").alias("w"), F.sum("score").alias("s"), F.count("*").alias("n"))
    g = s.groupBy("status").agg(F.sum("ws").alias("ws"), F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return g.select("status", r6(F.col("ws") / F.col("w"), "token_mean"), r6(F.col("s") / F.col("n"), "sample_mean"))


@R.add("SELECT event_id, (count(*) OVER (ORDER BY event_id))::BIGINT AS prompts, sum(user_id) OVER (ORDER BY event_id)::BIGINT AS tokens FROM events")
def ag28_cumulative_counters(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    counts = {"prompts": F.lit(1).cast("bigint"), "tokens": F.col("user_id")}
    return M.cumulative_counters(e, "event_id", counts).drop("user_id")


@R.add("SELECT CASE WHEN p_name LIKE '%a%' THEN 'with a' ELSE 'other' END AS category, count(*) AS n, round(sum(p_retailprice),2) AS total FROM (SELECT lower(p_name) AS p_name, p_retailprice FROM part) GROUP BY 1")
def ag33_time_by_category(spark, sf):
    p = table(spark, sf, "part").groupBy(P.kernel_category(F.col("p_name"), [("with a", ["a"])], "other").alias("category"))
    return p.agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@R.add("SELECT md5(text) AS fingerprint, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1")
def ag34_ids_by_fingerprint(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("fingerprint")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


@R.add(f"WITH {SAMPLES} SELECT source_name, round(avg(reward),6) AS reward, round(avg((status='truncated')::INT),6) AS truncated FROM samples GROUP BY 1")
def ag37_evaluation_log(spark, sf):
    return samples(spark, sf).groupBy("source_name").agg(r6(F.avg("reward"), "reward"), r6(F.avg((F.col("status") == "truncated").cast("int")), "truncated"))


@R.add("SELECT event_id, c_name FROM events LEFT JOIN customer ON user_id=c_custkey")
def jn2_attached_axis(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return table(spark, sf, "events").join(c, "user_id", "left").select("event_id", "c_name")


@R.add("SELECT event_id, doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events JOIN documents ON doc_id=user_id")
def jn7_fetched_documents(spark, sf):
    hits = table(spark, sf, "events").select("event_id", F.col("user_id").alias("doc_id")).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("event_id")).cast("bigint"))
    return hits.join(table(spark, sf, "documents").select("doc_id"), "doc_id").select("event_id", "doc_id", "rank")


@R.add(f"WITH {TOKENS} SELECT vec_id, list(x ORDER BY i) FILTER (WHERE i IN (0,2,4)) AS local FROM tok GROUP BY 1")
def jn11_local_view(spark, sf):
    return tokens(spark, sf).select("vec_id", F.transform(F.array(*map(F.lit, (0, 2, 4))), lambda i: F.get("x", i)).alias("local"))


@R.add(f"WITH {TOKENS} SELECT vec_id, round(sum(x*mask)/greatest(sum(mask),1),6) AS mean, min(x) FILTER (WHERE mask>0) AS low, max(x) FILTER (WHERE mask>0) AS high FROM tok GROUP BY 1")
def ta16_masked_mean_min_max(spark, sf):
    x, m = F.col("x"), F.col("mask")
    return tokens(spark, sf).select("vec_id", r6(T.masked_mean(x, m), "mean"), T.masked_min(x, m).alias("low"), T.masked_max(x, m).alias("high"))


@R.add(f"WITH {TOKENS} SELECT vec_id, round(sum(logp) FILTER (WHERE i>=n-5),6) AS tail FROM (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n FROM tok) GROUP BY 1")
def td8_teacher_tail(spark, sf):
    return tokens(spark, sf).select("vec_id", r6(T.total(P.teacher_tail(F.col("logp"), F.lit(5))), "tail"))


@R.add("SELECT o_orderkey AS id, o_totalprice AS price, NULL::BIGINT AS size FROM orders UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def so2_union_of_columns(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("size"))
    return o.unionByName(p, allowMissingColumns=True)


@R.add("SELECT vec_id, i::INT AS i, x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding,1)-1 AS i FROM embeddings)")
def so4_flattened(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
