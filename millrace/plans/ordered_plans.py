"""Curves, streaks, forgetting, intervals and spans over orders, events and line items."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ordered as O
from ..operators.spans import clipped_spans
from .base import SAMPLES, Registry, r6, samples, table

R = Registry()

CURVE = "curve AS (SELECT o_orderpriority AS run, (year(o_orderdate)*12+month(o_orderdate)) AS step, max(o_totalprice) AS score FROM orders GROUP BY ALL)"


def curve(spark, sf):
    step = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run"), step.alias("step")).agg(F.max("o_totalprice").alias("score"))


@R.add(f"WITH {CURVE}, d AS (SELECT run, step-lag(step) OVER w AS dx, (score+lag(score) OVER w)/2 AS my FROM curve WINDOW w AS (PARTITION BY run ORDER BY step)) SELECT run, round(sum(dx*my),3) AS auc, round(sum(dx*my)/sum(dx),3) AS normalized_auc FROM d GROUP BY 1")
def wn1_curve_area(spark, sf):
    return O.curve_area(curve(spark, sf), ["run"], "step", "score").select("run", F.round("auc", 3).alias("auc"), F.round("normalized_auc", 3).alias("normalized_auc"))


@R.add(f"WITH {CURVE}, m AS (SELECT run, least(score, lead(score) OVER w, lead(score,2) OVER w) AS low, lead(score,2) OVER w AS third FROM curve WINDOW w AS (PARTITION BY run ORDER BY step)) SELECT run, coalesce(bool_or(low > 400000 AND third IS NOT NULL), false) AS unstable FROM m GROUP BY 1")
def wn3_three_in_a_row(spark, sf):
    return O.three_in_a_row(curve(spark, sf), ["run"], "step", "score", 400000)


@R.add(
    """WITH t AS (SELECT user_id AS run, event_id AS step, CASE WHEN event_id%401=0 THEN 'nan'::DOUBLE WHEN event_id%307=0 THEN NULL ELSE value END AS norm, value>40 AS clipped FROM events),
r AS (SELECT user_id AS run, CASE WHEN user_id%7<>0 THEN max(event_id) END AS updates FROM events GROUP BY 1), e AS (SELECT user_id AS run, event_id AS step, CASE WHEN event_id%211=0 THEN 'inf'::DOUBLE ELSE value END AS score FROM events WHERE event_id%5<>0),
f AS (SELECT *, least(norm, lead(norm) OVER w, lead(norm,2) OVER w) AS low, lead(norm,2) OVER w AS third FROM t WHERE norm IS NOT NULL AND isfinite(norm) WINDOW w AS (PARTITION BY run ORDER BY step)),
h AS (SELECT run, bool_or(low>30 AND third IS NOT NULL) AS high FROM f GROUP BY 1), s AS (SELECT run, bool_or(norm IS NULL OR NOT isfinite(norm)) AS broken, avg(clipped::INT) AS share FROM t GROUP BY 1),
c AS (SELECT run, bool_or(NOT isfinite(score)) AS odd, bool_or(isfinite(score) AND step=updates) AS final FROM e JOIN r USING (run) GROUP BY 1)
SELECT run, list_filter([CASE WHEN updates IS NULL THEN 'incomplete' END, CASE WHEN odd THEN 'score_not_finite' END, CASE WHEN final IS NOT TRUE THEN 'final_missing' END, CASE WHEN broken THEN 'norm_not_finite' END, CASE WHEN high THEN 'three_norms' END, CASE WHEN share>0.5 THEN 'clipped' END], lambda x: x IS NOT NULL) AS faults
FROM r LEFT JOIN c USING (run) LEFT JOIN s USING (run) LEFT JOIN h USING (run)"""
)
def wn3_run_faults(spark, sf):
    """Users as runs: values are norms and scores, of which some are missing or not finite; every seventh run isn't complete."""
    e, k = table(spark, sf, "events").withColumnRenamed("user_id", "run").withColumnRenamed("event_id", "step"), F.col("step")
    odd = lambda n, x: F.when(k % n == 0, F.lit(x).cast("double"))
    train = e.select("run", "step", odd(401, "nan").when(k % 307 == 0, F.lit(None)).otherwise(F.col("value")).alias("norm"), (F.col("value") > 40).cast("int").alias("clipped"))
    evals = e.filter(k % 5 != 0).select("run", "step", odd(211, "inf").otherwise(F.col("value")).alias("score"))
    runs = e.groupBy("run").agg(F.max("step").alias("last")).select("run", F.when(F.col("run") % 7 != 0, F.col("last")).alias("updates"))
    return O.run_faults(train, evals, runs, "run", 30.0).select("run", "faults")


@R.add(f"WITH {CURVE}, l AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS k FROM curve) SELECT run, round(regr_slope(score, step),3) AS slope, round(max(score) FILTER (k=1) - max(score) FILTER (k=3),3) AS gain FROM l WHERE k<=3 GROUP BY 1")
def wn4_slope_of_last_three(spark, sf):
    k = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("step")))
    last = curve(spark, sf).withColumn("k", k).filter("k <= 3")
    return last.groupBy("run").agg(F.round(F.regr_slope("score", "step"), 3).alias("slope"), F.round(F.max(F.when(F.col("k") == 1, F.col("score"))) - F.max(F.when(F.col("k") == 3, F.col("score"))), 3).alias("gain"))


@R.add(f"WITH {CURVE} SELECT run, step, round(first_value(score) OVER w,3) AS first, round(max(score) OVER w,3) AS best, round(max(score) OVER w - score,3) AS forgetting, round(score-first_value(score) OVER w,3) AS backward_transfer FROM curve WINDOW w AS (PARTITION BY run ORDER BY step)")
def wn5_forgetting(spark, sf):
    return O.forgetting(curve(spark, sf), "run", "step", "score").select("run", "step", *[F.round(c, 3).alias(c) for c in ("first", "best", "forgetting", "backward_transfer")])


SPANS = "spans AS (SELECT user_id, epoch_us(ts)/1e6 AS start, epoch_us(ts)/1e6 + greatest(value,0)*60 AS stop FROM events)"


def user_spans(spark, sf):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf, "events").select("user_id", start.alias("start"), (start + F.greatest(F.col("value"), F.lit(0)) * 60).alias("stop"))


ISLANDS = f"{SPANS}, r AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans), i AS (SELECT *, sum(CASE WHEN start<=reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start, stop) AS island FROM r), m AS (SELECT user_id, island, min(start) AS start, max(stop) AS stop FROM i GROUP BY ALL)"


@R.add(f"WITH {ISLANDS} SELECT user_id, count(*) AS islands, round(sum(stop-start),1) AS busy, round(sum(stop-start)/(max(stop)-min(start)),6) AS utilisation FROM m GROUP BY 1 HAVING max(stop)>min(start)")
def wn6_merged_intervals(spark, sf):
    m = O.merged_intervals(user_spans(spark, sf), ["user_id"], "start", "stop")
    busy, span = F.sum(F.col("stop") - F.col("start")), F.max("stop") - F.min("start")
    return m.groupBy("user_id").agg(F.count("*").alias("islands"), F.round(busy, 1).alias("busy"), r6(F.try_divide(busy, span), "utilisation"), span.alias("s")).filter("s > 0").drop("s")


@R.add(f"WITH {ISLANDS}, g AS (SELECT user_id, start-lag(stop) OVER (PARTITION BY user_id ORDER BY start) AS gap FROM m) SELECT user_id, count(gap) AS gaps, round(max(gap),1) AS longest FROM g WHERE gap IS NOT NULL GROUP BY 1")
def wn7_idle_gaps(spark, sf):
    g = O.idle_gaps(O.merged_intervals(user_spans(spark, sf), ["user_id"], "start", "stop"), ["user_id"])
    return g.groupBy("user_id").agg(F.count("gap").alias("gaps"), F.round(F.max("gap"), 1).alias("longest"))


@R.add("WITH b AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1)//3 AS batch, value FROM events) SELECT user_id, batch::BIGINT AS batch, round(sum(value),6) AS total FROM b GROUP BY ALL HAVING count(*)=3")
def wn9_batches_of_three(spark, sf):
    return O.batches(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 3, "value").select("user_id", F.col("batch").cast("bigint").alias("batch"), r6(F.col("total"), "total"))


@R.add("WITH e AS (SELECT event_id, user_id, CASE WHEN event_id%3<>0 THEN epoch_us(ts) WHEN event_id%2=0 THEN epoch_us(ts)+json_extract(props,'$.k')::BIGINT*86400000000 END AS t FROM events), t AS (SELECT user_id FROM e GROUP BY 1 ORDER BY max(t) DESC NULLS LAST, user_id LIMIT 5) SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM t)")
def wn14_newest_groups(spark, sf):
    """Every third event has no time of its own; half of these have one that their properties tell, so many days later."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    told = F.when(k % 2 == 0, micros + F.get_json_object("props", "$.k").cast("bigint") * 86_400_000_000)
    return O.newest_groups(e, "user_id", F.when(k % 3 != 0, micros), 5, told).select("event_id", "user_id")


@R.add("WITH x AS (SELECT vec_id, generate_subscripts(embedding,1)-1 AS i, unnest(embedding) AS v FROM embeddings), h AS (SELECT vec_id, i, i-row_number() OVER (PARTITION BY vec_id ORDER BY i) AS run FROM x WHERE v>0) SELECT vec_id, min(i)::INT AS start, count(*) AS length FROM h GROUP BY vec_id, run")
def wn16_mask_runs(spark, sf):
    return O.runs_of_ones(table(spark, sf, "embeddings"), "vec_id", F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)))


@R.add("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def wn17_first_seen(spark, sf):
    return O.first_seen(table(spark, sf, "documents").select("text", "doc_id"), "text", ["doc_id"])


@R.add("WITH p AS (SELECT user_id, ts, value>50 AS ok, lag(value>50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT count(*) AS matched, count(*) FILTER (b AND NOT ok) AS pass_to_fail, count(*) FILTER (NOT b AND ok) AS fail_to_pass FROM p WHERE b IS NOT NULL")
def jn13_transitions(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("value") > 50).alias("ok"))
    return O.transitions(e, ["user_id"], "at", "ok")


@R.add(
    """WITH RECURSIVE numbered AS (SELECT user_id AS trace, epoch_us(ts) AS time, event_type AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS k FROM events),
e AS (SELECT trace, k AS pos, name, time, CASE WHEN k%7=6 THEN 'point' WHEN k%2=0 THEN 'span_start' ELSE 'span_end' END AS kind, CASE WHEN k%2=0 THEN k ELSE k//6*2 END AS span,
 CASE WHEN k%30=20 THEN k+2 WHEN k%30=22 THEN k-2 WHEN k%10=4 THEN -1 WHEN k%6<>0 THEN k//4*2 END AS parent FROM numbered),
p AS (SELECT *, lag(kind) OVER w AS before, lead(kind) OVER w AS after, lead(time) OVER w AS stop, lead(pos) OVER w AS closed_at FROM e WHERE kind<>'point' WINDOW w AS (PARTITION BY trace, span ORDER BY pos)),
s AS (SELECT trace, span, parent, CASE WHEN kind='span_start' THEN time END AS start, CASE WHEN kind='span_end' THEN time WHEN after='span_end' THEN stop END AS stop,
 CASE WHEN kind='span_end' THEN 'orphan' WHEN after='span_end' THEN 'closed' ELSE 'open' END AS state FROM p WHERE (kind='span_end' AND before IS DISTINCT FROM 'span_start') OR (kind='span_start' AND after IS DISTINCT FROM 'span_start')),
known AS (SELECT trace, span, parent, stop FROM s WHERE state<>'orphan'),
up AS (SELECT trace, span, parent AS at, 0 AS n FROM s WHERE state='open' UNION ALL SELECT up.trace, up.span, known.parent, n+1 FROM up JOIN known ON known.trace=up.trace AND known.span=up.at WHERE known.stop IS NULL AND n<2000),
c AS (SELECT s.*, (SELECT max(time) FROM e WHERE e.trace=s.trace) AS row_end, (SELECT min(o.start) FROM s o WHERE o.state<>'orphan' AND o.trace=s.trace AND o.parent IS NOT DISTINCT FROM s.parent AND o.start>s.start) AS next_start,
 (SELECT max(k.stop) FROM up JOIN known k ON k.trace=up.trace AND k.span=up.at WHERE up.trace=s.trace AND up.span=s.span AND k.stop IS NOT NULL) AS up_stop FROM s),
d AS (SELECT *, least(row_end, next_start, CASE WHEN up_stop>start THEN up_stop END) AS low FROM c)
SELECT trace, span, start, stop, state, CASE state WHEN 'closed' THEN stop WHEN 'open' THEN greatest(low, start) END AS display_stop,
 CASE WHEN state<>'open' THEN NULL WHEN low<=start THEN 'self' WHEN low=row_end THEN 'row_end' WHEN low=next_start THEN 'next_sibling_start' ELSE 'ancestor_end' END AS clipped_by FROM d"""
)
def jn8_paired_spans(spark, sf):
    """Each user's events in order: points, starts with parents (some missing, some in a cycle) and ends, of which many have no start left."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint") - 1
    e = table(spark, sf, "events").select(F.col("user_id").alias("trace"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), F.col("event_type").alias("name"), k.alias("pos"))
    kind = F.expr("CASE WHEN pos % 7 = 6 THEN 'point' WHEN pos % 2 = 0 THEN 'span_start' ELSE 'span_end' END")
    span = F.expr("CASE WHEN pos % 2 = 0 THEN pos ELSE pos div 6 * 2 END")
    parent = F.expr("CASE WHEN pos % 30 = 20 THEN pos + 2 WHEN pos % 30 = 22 THEN pos - 2 WHEN pos % 10 = 4 THEN -1 WHEN pos % 6 <> 0 THEN pos div 4 * 2 END")
    found = clipped_spans(e.select("*", kind.alias("kind"), span.alias("span"), parent.alias("parent")))
    return found.select("trace", "span", "start", "stop", "state", "display_stop", "clipped_by")


@R.add("WITH RECURSIVE s AS (SELECT event_id AS span, CASE WHEN event_id%10=0 THEN NULL WHEN event_id%97=1 THEN -5 ELSE event_id-1-(event_id%3) END AS parent FROM events), d AS (SELECT span, 0 AS depth FROM s WHERE parent IS NULL OR parent NOT IN (SELECT span FROM s) UNION ALL SELECT s.span, d.depth+1 FROM s JOIN d ON s.parent=d.span) SELECT span, depth::BIGINT AS depth FROM d")
def jn12_span_depths(spark, sf):
    p = F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_id") % 97 == 1, F.lit(-5)).otherwise(F.col("event_id") - 1 - F.col("event_id") % 3)
    return O.span_depths(table(spark, sf, "events").select(F.col("event_id").alias("span"), p.cast("bigint").alias("parent")))


def rounded_seconds(ts):
    """Seconds in whole milliseconds, halves away from 1970, as `epoch_ms` of SQL has them; `unix_millis` cuts off what is below one."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.call_function("div", F.when(micros < 0, micros - 500).otherwise(micros + 500), F.lit(1000)) / 1000.0


@R.add("WITH g AS (SELECT event_id AS gap_id, epoch_ms(ts)/1000.0 AS a, epoch_ms(ts)/1000.0+30 AS b FROM events WHERE event_id%5=0), o AS (SELECT event_id AS pos, event_type AS name, epoch_ms(ts)/1000.0 AS s, epoch_ms(ts)/1000.0+600 AS e FROM events WHERE event_id%5<>0) SELECT gap_id, arg_min_null(name,pos) AS name FROM g JOIN o ON s<b AND e>a GROUP BY 1")
def jn9_gap_to_first_op(spark, sf):
    e = table(spark, sf, "events").withColumn("s", rounded_seconds("ts"))
    gaps = e.filter("event_id % 5 = 0").select(F.col("event_id").alias("gap_id"), F.col("s").alias("from"), (F.col("s") + 30).alias("to"))
    ops = e.filter("event_id % 5 <> 0").select(F.col("event_id").alias("pos"), F.col("event_type").alias("name"), F.col("s").alias("start"), (F.col("s") + 600).alias("stop"))
    return O.overlapping(gaps, ops, 600.0)


@R.add(
    """WITH t AS (SELECT event_id, event_type, epoch_ms(ts)/1000.0 AS s, value FROM events), g AS (SELECT event_id AS gap_id, s-abs(value)*10 AS a, s+abs(value)*90 AS b FROM t WHERE event_id%5=0),
o AS (SELECT event_id AS pos, event_type AS name, s, s+abs(value)*(CASE WHEN event_id%97=1 THEN 1000 ELSE 3 END) AS e FROM t WHERE event_id%5<>0), top AS (SELECT * FROM g ORDER BY b-a DESC, gap_id LIMIT 15)
SELECT gap_id, round(any_value(b-a),3) AS gap, arg_min(name,pos) AS name FROM top LEFT JOIN o ON s<b AND e>a GROUP BY 1"""
)
def jn9_longest_gaps(spark, sf):
    """Gaps and ops of very different lengths around each event."""
    e, v = table(spark, sf, "events").withColumn("s", rounded_seconds("ts")), F.abs("value")
    gaps = e.filter("event_id % 5 = 0").select(F.col("event_id").alias("gap_id"), (F.col("s") - v * 10).alias("from"), (F.col("s") + v * 90).alias("to"))
    long = F.when(F.col("event_id") % 97 == 1, 1000).otherwise(3)
    ops = e.filter("event_id % 5 <> 0").select(F.col("event_id").alias("pos"), F.col("event_type").alias("name"), F.col("s").alias("start"), (F.col("s") + v * long).alias("stop"))
    return O.longest_gaps(gaps, ops, 60.0).select("gap_id", F.round("gap", 3).alias("gap"), "name")


@R.add(
    """WITH r AS (SELECT o_orderpriority AS arm, o_custkey%50 AS seed, o_orderstatus AS task, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY ALL)
SELECT a.arm, a.task, count(*) AS pairs, round(avg(a.v-b.v),3) AS effect FROM r a JOIN r b ON b.arm='1-URGENT' AND a.arm<>'1-URGENT' AND a.task=b.task AND a.seed=b.seed GROUP BY ALL"""
)
def jn1_paired_effects(spark, sf):
    """Priorities as arms, customers as seeds; of several orders the last counts."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("arm"), (F.col("o_custkey") % 50).alias("seed"), F.col("o_orderstatus").alias("task"), "o_totalprice", "o_orderkey")
    e = O.paired_effects(o, "arm", "1-URGENT", ["seed"], ["task"], "o_totalprice", "o_orderkey")
    return e.select("arm", "task", "pairs", F.round("effect", 3).alias("effect"))


@R.add("WITH r AS (SELECT DISTINCT o_orderpriority AS arm, o_custkey AS seed FROM orders) SELECT seed FROM r GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def jn10_seeds_in_all_arms(spark, sf):
    r = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("arm"), F.col("o_custkey").alias("seed")).distinct()
    total = r.select("arm").distinct().agg(F.count("*").alias("arms"))  # one row
    return r.groupBy("seed").agg(F.count("*").alias("n")).join(F.broadcast(total)).filter("n = arms").select("seed")


@R.add(f"WITH {SAMPLES} SELECT source_name, index, count(*) AS n, dense_rank() OVER (PARTITION BY source_name ORDER BY count(*) DESC)::INT AS rank FROM samples GROUP BY 1, 2")
def wn_ranked_sizes(spark, sf):
    g = samples(spark, sf).groupBy("source_name", "index").agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.dense_rank().over(Window.partitionBy("source_name").orderBy(F.desc("n"))))
