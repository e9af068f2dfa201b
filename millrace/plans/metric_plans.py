"""Metrics of rollouts, steps and runs, packing plans, and small decisions, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics as M
from ..operators import packing as P
from ..operators import sketches as K
from .base import SAMPLES, TOKENS, Registry, r6, samples, table, tokens
from .step_plans import HIST, entries

R = Registry()


@R.add("SELECT label, round(sum(w*m)/sum(m),6) AS kept_per_token FROM (SELECT label, vec_id, i, (i%4)+1.0 AS w, CASE WHEN i%3=0 THEN 0 ELSE 1 END AS m FROM (SELECT label, vec_id, generate_subscripts(embedding,1)-1 AS i FROM embeddings)) WHERE vec_id%5<>0 GROUP BY 1")
def ag9_kept_vocabulary(spark, sf):
    n = F.size("embedding")
    offsets = F.transform(F.sequence(F.lit(0), n), lambda i: (F.floor(i / 4) * 10 + F.pmod(i, F.lit(4)) * (F.pmod(i, F.lit(4)) + 1) / 2).cast("bigint"))
    mask = F.transform("embedding", lambda x, i: F.when(i % 3 == 0, 0.0).otherwise(1.0))
    g = table(spark, sf, "embeddings").groupBy("label").agg(*M.kept_vocabulary(offsets, mask, F.col("vec_id") % 5 == 0))
    return g.select("label", r6(F.col("kept_per_token"), "kept_per_token"))


@R.add("SELECT l_returnflag, round(sum(l_discount)/sum(l_quantity),9) AS hit_rate, round(sum(l_discount)/count(*),9) AS cached_per_sample FROM lineitem GROUP BY 1")
def ag11_prefix_cache(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*M.prefix_cache(F.col("l_discount"), F.col("l_quantity")))
    return g.select("l_returnflag", *[F.round(c, 9).alias(c) for c in ("hit_rate", "cached_per_sample")])


@R.add("WITH e AS (SELECT event_type AS key, value FROM events WHERE event_id%7<>0 UNION ALL SELECT 'id', event_id::DOUBLE FROM events) SELECT key, count(*) AS n, round(avg(value),6) AS mean, round(median(value),6) AS median, max(value) AS max, min(value) AS min FROM e GROUP BY 1")
def ag14_attribute_statistics(spark, sf):
    v = F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col("value"))
    g = M.attribute_statistics(table(spark, sf, "events").select(F.create_map("event_type", v, F.lit("id"), F.col("event_id").cast("double")).alias("m")), "m")
    return g.select("key", "n", r6(F.col("mean"), "mean"), r6(F.col("median"), "median"), "max", "min")


@R.add("SELECT o_custkey, min(o_orderkey) AS first, count(*) AS rows FROM orders GROUP BY 1")
def ag16_ordered_groups(spark, sf):
    return M.ordered_groups(table(spark, sf, "orders"), "o_custkey", "o_orderkey")


@R.add("SELECT l_returnflag AS run, 'loss' AS metric, round(sum(l_discount*l_quantity)/sum(l_quantity),6) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'lr', round(sum(l_tax)/4,6) FROM lineitem GROUP BY 1")
def ag18_merged_parts(spark, sf):
    df = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run"), (F.col("l_linenumber") % 4).alias("rank"))
    df = df.agg(F.sum(F.col("l_discount") * F.col("l_quantity")).alias("s"), F.sum("l_quantity").alias("n"), F.sum("l_tax").alias("t"))
    parts = F.array(F.struct(F.lit("loss").alias("metric"), M.contribution(F.col("s"), F.col("n")).alias("part")), F.struct(F.lit("lr").alias("metric"), M.contribution(F.col("t"), F.lit(None)).alias("part")))
    long = df.select("run", F.explode(parts).alias("e"), F.lit(4).alias("parts")).select("run", "e.*", "parts")
    return M.merged_parts(long, ["run"], "metric", "part", "parts").select("run", "metric", r6(F.col("value"), "value"))


@R.add("SELECT l_returnflag, round(sum(l_discount),6) AS total, count(*)::DOUBLE AS count FROM lineitem GROUP BY 1")
def ag20_contribution(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(M.contribution(F.sum("l_discount"), F.count("*")).alias("p"))
    return g.select("l_returnflag", r6(F.col("p.total"), "total"), F.col("p.count").alias("count"))


@R.add(f"WITH {SAMPLES} SELECT * FROM (SELECT 'reward' AS name, round(avg(reward),6) AS mean, round(avg(reward) FILTER (reward=1),6) AS correct_mean FROM samples UNION ALL SELECT 'response_length', round(avg(response_length),6), round(avg(response_length) FILTER (reward=1),6) FROM samples UNION ALL SELECT 'score', round(avg(score),6), round(avg(score) FILTER (reward=1),6) FROM samples)")
def ag21_column_means(spark, sf):
    m = M.column_means(samples(spark, sf), ["group_index", "index", "price"], F.col("reward") == 1)
    return m.select("name", r6(F.col("mean"), "mean"), r6(F.col("correct_mean"), "correct_mean"))


@R.add("SELECT l_linestatus, round(avg((l_quantity>=40)::INT),6) AS clip_ratio, round(avg(l_quantity),6) AS raw_mean, max(l_quantity) AS raw_max, round(avg(l_quantity-l_linenumber),6) AS own_mean, min(l_quantity-l_linenumber) AS own_min, max(l_linenumber) AS rounds_max FROM lineitem GROUP BY 1")
def ag23_turn_lengths(spark, sf):
    q = F.col("l_quantity")
    g = table(spark, sf, "lineitem").groupBy("l_linestatus").agg(*M.turn_lengths(q, q - F.col("l_linenumber"), F.col("l_linenumber"), 40))
    return g.select("l_linestatus", r6(F.col("clip_ratio"), "clip_ratio"), r6(F.col("raw_mean"), "raw_mean"), "raw_max", r6(F.col("own_mean"), "own_mean"), "own_min", "rounds_max")


@R.add(
    """WITH g AS (SELECT count(*) AS n, sum((event_type='click')::INT)::BIGINT AS c FROM events GROUP BY event_id//4), k AS (SELECT unnest([1,2,4]) AS k),
e AS (SELECT k, CASE WHEN n-c<k THEN 1.0 WHEN c=0 THEN 0.0 ELSE 1-(SELECT product(1-k/i) FROM (SELECT unnest(generate_series(n-c+1,n)) AS i)) END AS p FROM g, k WHERE n>=k)
SELECT k::INT AS k, round(avg(p),6) AS pass_at_k, count(*) AS groups FROM e GROUP BY 1"""
)
def ag24_contiguous_pass_rates(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_type") == "click").cast("double").alias("reward"))
    return M.contiguous_pass_rates(e, "event_id", "reward", 4, [1, 2, 4]).select("k", r6(F.col("pass_at_k"), "pass_at_k"), "groups")


@R.add("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity),6) AS mean, round(stddev_pop(l_quantity),6) AS std FROM lineitem GROUP BY 1")
def ag27_merged_distributions(spark, sf):
    q = F.col("l_quantity").cast("double")
    shards = table(spark, sf, "lineitem").groupBy("l_returnflag", (F.col("l_orderkey") % 8).alias("shard")).agg(F.count("*").alias("n"), F.avg(q).alias("mean"), (F.var_pop(q) * F.count("*")).alias("m2"))
    return M.merged_distributions(shards, ["l_returnflag"], "n", "mean", "m2").select("l_returnflag", "n", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"))


@R.add(
    """WITH t AS (SELECT o_orderpriority AS arm, month(o_orderdate) AS seed, avg(o_totalprice) AS price, CASE WHEN o_orderpriority='5-LOW' THEN NULL ELSE count(*) END::DOUBLE AS rows FROM orders GROUP BY 1, 2),
l AS (SELECT arm, seed, 'price' AS metric, price AS v FROM t UNION ALL SELECT arm, seed, 'rows', rows FROM t WHERE rows IS NOT NULL)
SELECT arm, metric, count(*) AS n, round(avg(v),4) AS mean, round(stddev_samp(v),4) AS sd, len(list(DISTINCT seed)) AS seeds FROM l GROUP BY 1, 2"""
)
def ag30_metric_estimates(spark, sf):
    low = F.col("o_orderpriority") == "5-LOW"
    t = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.month("o_orderdate").alias("seed")).agg(F.avg("o_totalprice").alias("price"), F.when(~F.first(low), F.count("*")).alias("rows"))
    e = M.metric_estimates(t, ["arm"], ["price", "rows"], "seed")
    return e.select("arm", "metric", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.size("seeds").cast("bigint").alias("seeds"))


@R.add("SELECT event_type AS run, round(min(value),6) AS value_min, round(avg(value),6) AS value_mean, round(max(value),6) AS value_max, round(sum(value),4) AS value_sum, round(arg_max(value,event_id),6) AS value_last FROM events GROUP BY 1")
def ag31_run_summary(spark, sf):
    s = M.run_summary(table(spark, sf, "events").withColumnRenamed("event_type", "run"), "run", "event_id", ["value"])
    return s.select("run", *[r6(F.col(f"value_{n}"), f"value_{n}") for n in ("min", "mean", "max")], F.round("value_sum", 4).alias("value_sum"), r6(F.col("value_last"), "value_last"))


@R.add(
    """WITH e AS (SELECT o_custkey AS run, CASE WHEN o_orderstatus='F' THEN 'final' ELSE 'eval' END AS phase, year(o_orderdate) AS update, o_orderkey FROM orders),
m AS (SELECT run, max(CASE WHEN phase='final' THEN update END) AS f, max(update) AS a FROM e GROUP BY 1) SELECT run, o_orderkey FROM e JOIN m USING (run) WHERE (f IS NULL AND update=a) OR (phase='final' AND update=f)"""
)
def ag32_final_evaluation(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "final").otherwise("eval").alias("phase"), F.year("o_orderdate").alias("update"), "o_orderkey")
    return M.final_evaluation(e, "run", "phase", "update").select("run", "o_orderkey")


@R.add("SELECT event_type, sum(user_id%5+1)::DOUBLE AS busy, (max(event_id+user_id%5+1)-min(event_id))::DOUBLE AS span, round(sum(user_id%5+1)/(max(event_id+user_id%5+1)-min(event_id)),6) AS utilisation FROM events GROUP BY 1")
def wn8_stream_utilisation(spark, sf):
    start = F.col("event_id").cast("double")
    e = table(spark, sf, "events").select("event_type", start.alias("start"), (start + F.col("user_id") % 5 + 1).alias("stop"))
    return M.stream_utilisation(e, "event_type", "start", "stop").select("event_type", "busy", "span", r6(F.col("utilisation"), "utilisation"))


@R.add(
    f"""WITH {TOKENS}, t AS (SELECT * FROM tok WHERE i < vec_id % 40), d AS (SELECT vec_id, i, x + 0.9*coalesce(lead(adv) OVER (PARTITION BY vec_id ORDER BY i),0) - adv AS delta FROM t),
w AS (SELECT a.vec_id, a.i, sum(b.delta*pow(0.9*0.8,b.i-a.i)) AS v FROM d a JOIN d b ON a.vec_id=b.vec_id AND b.i>=a.i GROUP BY ALL) SELECT vec_id, count(*) AS n, round(sum(v*(i+1)),6) AS weighted FROM w GROUP BY 1"""
)
def wn13_ragged_advantages(spark, sf):
    """Rows of different lengths need no padding."""
    from ..functions import tokens as T

    n = (F.col("vec_id") % 40).cast("int")
    a = T.gae(F.slice("x", F.lit(1), n), F.slice("adv", F.lit(1), n), 0.9, 0.8)
    return tokens(spark, sf).filter(n > 0).select("vec_id", F.size(a).cast("bigint").alias("n"), r6(T.total(F.transform(a, lambda x, i: x * (i + 1))), "weighted"))


@R.add("SELECT o_custkey AS trace, 2*o_orderkey AS span, CASE WHEN k>1 THEN 2*first ELSE NULL END AS parent FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS k, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))")
def wn15_nested_spans(spark, sf):
    """The first order of a customer stays open, the others begin and end within it."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("trace"), F.col("o_orderkey").alias("k"))
    firsts = o.groupBy("trace").agg(F.min("k").alias("first"))
    both = F.array(F.struct((4 * F.col("k")).alias("order"), F.lit("start").alias("kind")), F.struct(F.when(F.col("k") == F.col("first"), F.lit(1 << 40)).otherwise(4 * F.col("k") + 1).alias("order"), F.lit("stop").alias("kind")))
    e = o.join(firsts, "trace").select("trace", (2 * F.col("k")).alias("span"), F.explode(both).alias("e")).select("trace", "span", "e.*")
    return M.nested_spans(e, "trace", "order", "kind", "span")


@R.add(
    """WITH e AS (SELECT label AS view, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
u AS (SELECT view, (k+k//7)::BIGINT AS update, embedding FROM e), v AS (SELECT view, max(len(embedding))::BIGINT AS numel, md5(view::VARCHAR) AS d FROM u GROUP BY 1),
s AS (SELECT view, numel, ('0x'||d[1:8])::BIGINT%numel AS start, CASE WHEN ('0x'||d[9:16])::BIGINT%numel=0 THEN 1 ELSE ('0x'||d[9:16])::BIGINT%numel END AS stride FROM v),
p AS (SELECT view, numel, unnest(range(0,16)) AS j, start, stride+(1-stride%2) AS stride FROM s),
c AS (SELECT p.view, p.j, u.update, u.embedding[((start+j*stride)%numel+1)::INT]>0 AS changed, numel/16.0 AS w FROM p JOIN u USING (view)),
g AS (SELECT *, update-dense_rank() OVER (PARTITION BY view ORDER BY update) AS run FROM c),
t AS (SELECT *, lag(changed) OVER (PARTITION BY view, j, run ORDER BY update) AS previous, avg(changed::INT) OVER r AS frequency, NOT bool_or(changed) OVER r AS never, update>1 AND lag(update) OVER (PARTITION BY view, j, run ORDER BY update) IS NULL AS broken
 FROM g WINDOW r AS (PARTITION BY view, j, run ORDER BY update ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
x AS (SELECT *, unnest(['global','odd'||(view%2)]) AS "group" FROM t)
SELECT "group", update, count(*) AS sample_count, round(sum(w),9) AS population, round(sum(w*changed::INT)/sum(w),9) AS changed_share,
 CASE WHEN count(previous)>0 THEN round(CASE WHEN sum(w*(previous OR changed)::INT)>0 THEN sum(w*(previous AND changed)::INT)/sum(w*(previous OR changed)::INT) ELSE 1 END,9) END AS jaccard,
 round(sum(w*frequency)/sum(w),9) AS window_frequency, round(sum(w*never::INT)/sum(w),9) AS never_changed_share, NOT bool_or(broken) AS contiguous FROM x GROUP BY ALL"""
)
def wn18_update_support(spark, sf):
    """Vectors of a label are updates of a view, in order, of which every eighth is missing; positive components are changes."""
    k = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    e = table(spark, sf, "embeddings").withColumn("k", k).select(F.col("label").alias("view"), (F.col("k") + F.floor(F.col("k") / 7)).alias("update"), F.lit(0).cast("bigint").alias("offset"), F.transform("embedding", lambda x: F.when(x > 0, x).otherwise(0.0)).alias("values"))
    views = e.groupBy("view").agg(F.max(F.size("values")).cast("bigint").alias("numel")).withColumn("groups", F.array(F.lit("global"), F.concat(F.lit("odd"), F.col("view") % 2)))
    s = M.update_support(e, views, 16, 4)
    return s.select("group", "update", "sample_count", *[F.round(c, 9).alias(c) for c in ("population", "changed_share", "jaccard", "window_frequency", "never_changed_share")], "contiguous")


@R.add("SELECT event_id, least(32, 100-(event_id%4)*32)::BIGINT AS prompts, event_id*32*8//64 AS updates FROM events")
def wn19_prompts_and_updates(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", M.rollout_prompts(e, 32, 100, 4).cast("bigint").alias("prompts"), M.updates_before(e, 32, 8, 64).alias("updates"))


@R.add(
    f"WITH {HIST}, c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY label ORDER BY coalesce(bin,-1) DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS above, sum(n) OVER (PARTITION BY label) AS total FROM hist) SELECT label, round(sum(energy*greatest(least(n, greatest(ceil(total*0.1),1)-above),0)/n)/sum(energy),6) AS share FROM c GROUP BY 1"
)
def sk6_top_energy_share(spark, sf):
    return M.top_energy_share(K.histogram(entries(spark, sf), ["label"], "v"), ["label"], 0.1).select("label", r6(F.col("share"), "share"))


@R.add("WITH g AS (SELECT l_linenumber AS cap, count(DISTINCT l_suppkey%3) AS n, avg(l_tax) AS m FROM lineitem WHERE l_suppkey%3 IN (0,1) GROUP BY 1) SELECT min(cap) AS selected FROM g WHERE n=2 AND m<=0.0401")
def sl15_smallest_cap(spark, sf):
    runs = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("cap"), (F.col("l_suppkey") % 3).alias("seed"), "l_tax")
    return M.smallest_cap(runs, "cap", "seed", "l_tax", [0, 1], 0.0401)


@R.add("SELECT o_orderpriority, round(avg(o_totalprice),4) AS gain, CASE WHEN avg(o_totalprice)<150000 AND max(o_custkey)<=0 THEN 'keep' ELSE CASE WHEN avg(o_totalprice)<150000 AND o_orderpriority='none' THEN 'keep' ELSE 'double' END END AS decision FROM orders GROUP BY 1")
def sl16_budget_decision(spark, sf):
    d = M.budget_decision(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", "o_custkey", 150000.0)
    return d.select("o_orderpriority", F.round("gain", 4).alias("gain"), "decision")


@R.add(
    """WITH g AS (SELECT o_custkey, count(*)%2=0 AS keep FROM orders GROUP BY 1), w AS (SELECT *, count(*) OVER () - row_number() OVER o AS left_, sum(keep::INT) OVER o AS have FROM g WINDOW o AS (ORDER BY o_custkey)),
u AS (SELECT *, NOT keep AND have+left_ < 600 AS short, sum((keep OR (NOT keep AND have+left_ < 600))::INT) OVER (ORDER BY o_custkey) AS used FROM w)
SELECT o_custkey, CASE WHEN (keep OR short) AND used<=600 THEN CASE WHEN keep THEN 'kept' ELSE 'filled' END WHEN keep THEN 'surplus' ELSE 'dropped' END AS state FROM u"""
)
def pf5_kept_or_filled(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg((F.count("*") % 2 == 0).alias("keep"))
    return M.kept_or_filled(g, "o_custkey", "keep", 600).select("o_custkey", "state")


@R.add("SELECT CASE event_type WHEN 'click' THEN 'math' ELSE 'code' END AS task, count(*) AS n, min(CASE event_type WHEN 'click' THEN 'Solve: ' ELSE 'Write: ' END || event_type) AS prompt FROM events WHERE event_type IN ('click','view') GROUP BY 1")
def pf13_routed_rows(spark, sf):
    e = table(spark, sf, "events").withColumn("prompt", F.col("event_type"))
    out = M.routed_rows(e, "event_type", {"click": ("math", "Solve: "), "view": ("code", "Write: ")})
    return out.groupBy("task").agg(F.count("*").alias("n"), F.min("prompt").alias("prompt"))


@R.add("SELECT conv_id, turn, CASE WHEN turn%2=0 THEN role ELSE 'user' END AS role, md5(text) AS content FROM conversations")
def pf14_messages(spark, sf):
    nested = F.when(F.col("turn") % 2 == 0, F.array(F.struct("role", F.col("text").alias("content"))))
    df = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(M.messages_of(nested, F.col("text"))).alias("m"))
    return df.select("conv_id", "turn", "m.role", F.md5("m.content").alias("content"))


@R.add("SELECT event_id, coalesce(CASE WHEN event_id%3=0 THEN event_type END, CASE WHEN event_id%3=1 THEN 'default' END, 'args') AS setting FROM events")
def pf22_first_configured(spark, sf):
    n = F.col("event_id") % 3
    return table(spark, sf, "events").select("event_id", M.first_configured(F.when(n == 0, F.col("event_type")), F.when(n == 1, "default"), F.lit("args")).alias("setting"))


@R.add("SELECT r_name AS name, r_regionkey AS task FROM region WHERE r_name='ASIA'")
def jn5_single_source(spark, sf):
    return M.single_source(table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("task")), "ASIA").select("name", F.col("task").cast("int").alias("task"))


@R.add("SELECT CASE WHEN (event_id//16)%2=0 THEN 'math' ELSE 'code' END AS source, count(*) AS n FROM events GROUP BY 1")
def sl8_batch_source(spark, sf):
    source = M.batch_source(F.col("event_id"), 16, lambda b: F.when(b % 2 == 0, "math").otherwise("code"))
    return table(spark, sf, "events").groupBy(source.alias("source")).agg(F.count("*").alias("n"))


@R.add("SELECT o_custkey FROM (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS k FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*)%2=0)) WHERE k<=50")
def sl19_oversampled_fill(spark, sf):
    """What an oversampled request keeps: the first groups that survive the filter."""
    g = table(spark, sf, "orders").groupBy("o_custkey").agg((F.count("*") % 2 == 0).alias("keep"))
    return M.kept_or_filled(g, "o_custkey", "keep", 50).filter("state = 'kept'").select("o_custkey")


@R.add("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM events) AS events")
def sc5_row_counts(spark, sf):
    e = table(spark, sf, "events").agg(F.count("*").alias("events"))
    return table(spark, sf, "documents").agg(F.count("*").alias("documents")).join(F.broadcast(e))


# packing


def lengths(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", ((F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("int")).alias("pos"), F.col("l_quantity").cast("int").alias("length"))


@R.add(
    """WITH RECURSIVE l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey*100000+l_suppkey*10+l_linenumber)*100+l_quantity::INT) AS k, (l_partkey*100000+l_suppkey*10+l_linenumber)*100+l_quantity::INT AS line, l_quantity::INT AS n FROM lineitem),
p AS (SELECT o, k, line, n, CASE WHEN n>60 THEN [-1] ELSE [60-n] END AS room, 0 AS part FROM l WHERE k=1
UNION ALL SELECT l.o, l.k, l.line, l.n, CASE WHEN f.at IS NULL THEN list_append(p.room, CASE WHEN l.n>60 THEN -1 ELSE 60-l.n END) ELSE list_transform(p.room, lambda r, i: CASE WHEN i=f.at THEN r-l.n ELSE r END) END, coalesce(f.at-1, len(p.room))
 FROM p JOIN l ON l.o=p.o AND l.k=p.k+1, LATERAL (SELECT min(i) AS at FROM (SELECT unnest(range(1,len(p.room)+1)) AS i) WHERE p.room[i]>=l.n) f)
SELECT o AS l_orderkey, line AS pos, part::INT AS part FROM p"""
)
def pk3_first_fit(spark, sf):
    return P.grouped_plan(lengths(spark, sf), "l_orderkey", "pos", "length", lambda n: P.first_fit(n, 60))


def spreads(spark, sf, fits: str, equal_size: bool):
    """How far two parts lie apart, by order."""
    df = lengths(spark, sf)
    some = df.withColumn("count", F.count("*").over(Window.partitionBy("l_orderkey"))).filter(fits)
    plan = P.grouped_plan(some, "l_orderkey", "pos", "length", lambda n: P.balanced(n, 2, equal_size), sized=True)
    g = plan.groupBy("l_orderkey", "part").agg(F.sum("length").alias("n"), F.count("*").alias("items"))
    return g.groupBy("l_orderkey").agg(F.min("items").alias("fewest"), F.count("*").alias("parts"), (F.max("n") - F.min("n")).cast("int").alias("spread"))


#: Two parts lie apart by what is left when the two widest spreads are always replaced by their difference.
DIFFERENCES = """d AS (SELECT o, list_reverse_sort(g) AS g FROM g UNION ALL SELECT o, list_reverse_sort(list_append(g[3:], g[1]-g[2])) FROM d WHERE len(g)>1),
spread AS (SELECT o, g[1]::INT AS spread FROM d WHERE len(g)=1)"""


@R.add(f"WITH RECURSIVE g AS (SELECT l_orderkey AS o, list(l_quantity::INT) AS g FROM lineitem GROUP BY 1 HAVING count(*)>=2), {DIFFERENCES} SELECT o AS l_orderkey, 2::BIGINT AS parts, spread FROM spread")
def pk4_differencing(spark, sf):
    """The two parts of each order; which items they hold is compared with a plain version in the tests."""
    return spreads(spark, sf, "count >= 2", False).drop("fewest")


@R.add(
    """WITH RECURSIVE l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey*100000+l_suppkey*10+l_linenumber)*100+l_quantity::INT) AS k, (l_partkey*100000+l_suppkey*10+l_linenumber)*100+l_quantity::INT AS line, l_quantity::INT AS n FROM lineitem),
p AS (SELECT o, k, line, n AS a, 0 AS b, 0 AS part FROM l WHERE k=1 UNION ALL SELECT l.o, l.k, l.line, CASE WHEN a<=b THEN a+l.n ELSE a END, CASE WHEN a<=b THEN b ELSE b+l.n END, CASE WHEN a<=b THEN 0 ELSE 1 END FROM p JOIN l ON l.o=p.o AND l.k=p.k+1)
SELECT o AS l_orderkey, line AS pos, part::INT AS part FROM p"""
)
def pk5_greedy(spark, sf):
    return P.grouped_plan(lengths(spark, sf), "l_orderkey", "pos", "length", lambda n: P.greedy(n, 2))


@R.add(
    f"""WITH RECURSIVE g AS (SELECT o, list(n-before) AS g FROM (SELECT o, n, lag(n) OVER (PARTITION BY o ORDER BY k) AS before, k FROM (SELECT l_orderkey AS o, l_quantity::INT AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS k, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) WHERE c%2=0) WHERE k%2=0 GROUP BY 1),
{DIFFERENCES} SELECT o AS l_orderkey, (SELECT count(*)//2 FROM lineitem WHERE l_orderkey=o) AS fewest, spread FROM spread"""
)
def pk6_balanced_parts(spark, sf):
    """Two parts of equally many items: neighbours by length differ first, then differences of these."""
    return spreads(spark, sf, "count % 2 = 0", True).drop("parts")


#: Halves of a bin: longest first, each to the lighter.
HALVES = """{name} AS (SELECT o, k, line, n, n AS a, 0 AS b, 0 AS half FROM {of} WHERE k=1
UNION ALL SELECT l.o, l.k, l.line, l.n, CASE WHEN a<=b THEN a+l.n ELSE a END, CASE WHEN a<=b THEN b ELSE b+l.n END, CASE WHEN a<=b THEN 0 ELSE 1 END FROM {name} p JOIN {of} l ON l.o=p.o AND l.k=p.k+1)"""
LINES = "lines AS (SELECT l_orderkey AS o, (l_partkey*100000+l_suppkey*10+l_linenumber)*100+l_quantity::INT AS line, l_quantity::INT AS n FROM lineitem), l AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n DESC, line) AS k FROM lines)"
SPLIT = f"WITH RECURSIVE {LINES}, {HALVES.format(name='p', of='l')}"


@R.add(f"{SPLIT} SELECT o AS l_orderkey, line AS pos, half::INT AS part FROM p")
def pk7_split_bins(spark, sf):
    return P.grouped_plan(lengths(spark, sf), "l_orderkey", "pos", "length", lambda n: [p for p in P.split_bin(list(range(len(n))), n) if p])


@R.add(
    f"""{SPLIT}, bins AS (SELECT o, half, sum(n) AS total, count(*) AS items FROM p GROUP BY ALL), heavy AS (SELECT o, arg_max(half, total*2+half) AS half FROM bins WHERE items>1 GROUP BY 1),
m AS (SELECT p.o, p.line, p.n, row_number() OVER (PARTITION BY p.o ORDER BY p.n DESC, p.k) AS k FROM p JOIN heavy USING (o, half)), {HALVES.format(name='q', of='m')}
SELECT p.o AS l_orderkey, p.line AS pos, (CASE WHEN q.half=1 THEN 2 ELSE p.half END)::INT AS part FROM p LEFT JOIN q ON q.o=p.o AND q.line=p.line"""
)
def pk8_expanded_bins(spark, sf):
    """One bin an order, split into two and the heavier of these again, as far as they hold several items."""
    return P.grouped_plan(lengths(spark, sf), "l_orderkey", "pos", "length", lambda n: P.expanded([list(range(len(n)))], 3, n))


@R.add("SELECT o_orderkey, list_transform(range(0,5), lambda i: ((i-o_orderkey)*3%5+5)%5)::INT[] AS inverse FROM orders")
def pk9_inverse_permutation(spark, sf):
    turn = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.pmod(2 * i + F.col("o_orderkey"), F.lit(5)).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", P.inverse_permutation(turn).alias("inverse"))


@R.add("SELECT event_id//64 AS step, (event_id%64)//4%4 AS rank, list(event_id ORDER BY event_id) AS events, list((event_id%64)//4 ORDER BY event_id)::INT[] AS micro_batch FROM events WHERE event_id < (SELECT count(*)//64*64 FROM events) GROUP BY 1, 2")
def pk10_per_rank(spark, sf):
    """What each rank is sent of the whole steps: micro-batches of four neighbours, dealt in turn."""
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / 64).alias("step"), "event_id", (F.abs("value") * 10 + 1).cast("int").alias("length"))
    whole = e.join(e.groupBy("step").count().filter("count = 64").select("step"), "step")
    plan = P.packed_steps(whole, "step", "event_id", "length", 4, 4096, mode="fixed", size=4, even=False)
    sent = P.per_rank(plan, whole.withColumn("id", F.col("event_id")), ["step", "event_id"])
    return sent.select("step", F.col("rank").cast("bigint").alias("rank"), F.col("id").alias("events"), "micro_batch")


@R.add(
    """WITH RECURSIVE l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey*100000+l_suppkey*10+l_linenumber)*100+l_quantity::INT) AS k, (l_partkey*100000+l_suppkey*10+l_linenumber)*100+l_quantity::INT AS line, l_quantity::INT AS n FROM lineitem),
p AS (SELECT o, k, line, n AS total, 0 AS part FROM l WHERE k=1 UNION ALL SELECT l.o, l.k, l.line, CASE WHEN total+l.n>=70 THEN l.n ELSE total+l.n END, CASE WHEN total+l.n>=70 THEN part+1 ELSE part END FROM p JOIN l ON l.o=p.o AND l.k=p.k+1)
SELECT o AS l_orderkey, line AS pos, part::INT AS part FROM p"""
)
def pk11_size_chunks(spark, sf):
    return P.grouped_plan(lengths(spark, sf), "l_orderkey", "pos", "length", lambda n: P.chunked(n, 70))
