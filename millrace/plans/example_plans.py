"""Geometry, cursors, buffers, benchmark rows and run checks on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmarks as B
from ..operators import geometry as G
from ..sources import records as D
from ..sources import rollouts as L
from .base import Registry, r6, table

R = Registry()


def rounded(df, *keep):
    return df.select(*keep, *[r6(F.col(c), c) for c, t in df.dtypes if c not in keep and t == "double"], *[c for c, t in df.dtypes if c not in keep and t != "double"])


@R.add(
    "SELECT l_returnflag, " + ", ".join(f"round(sqrt(sum({c}*{c})),6) AS {n}_l2, round(sqrt(avg({c}*{c})),6) AS {n}_rms, round(max(abs({c})),6) AS {n}_linf, round(avg(({c}=0)::INT),6) AS {n}_zero_fraction" for n, c in (("a", "l_discount"), ("b", "l_tax")))
    + ", round(sum(l_discount*l_tax),6) AS a_b_dot, round(sum(l_discount*l_tax)/sqrt(sum(l_discount*l_discount))/sqrt(sum(l_tax*l_tax)),6) AS a_b_cosine FROM lineitem GROUP BY 1"
)
def sk8_grouped_geometry(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return rounded(G.grouped_geometry(rows, ["l_returnflag"], ["a", "b"], [("a", "b")]), "l_returnflag")


@R.add(
    """WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS c FROM embeddings), r AS (SELECT label, sqrt(sum(v*v)) AS n FROM e GROUP BY label, vec_id), k AS (SELECT label, sqrt(sum(v*v)) AS n FROM e GROUP BY label, c),
a AS (SELECT label, count(*) AS "rows", round(stddev_pop(n)/avg(n),6) AS row_norm_cv FROM r GROUP BY 1), b AS (SELECT label, count(*)::INT AS columns, round(stddev_pop(n)/avg(n),6) AS column_norm_cv FROM k GROUP BY 1) SELECT * FROM a JOIN b USING (label)"""
)
def sk9_matrix_norms(spark, sf):
    """The columns of the diagnostics that SQL can express; tests compare the spectrum with a decomposition."""
    rows = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("row"))
    return rounded(G.matrix_diagnostics(rows, "label", "row"), "label").select("label", "rows", "columns", "row_norm_cv", "column_norm_cv")


@R.add()
def sk9_matrix_spectra(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("row"))
    return rounded(G.matrix_diagnostics(rows, "label", "row"), "label")


@R.add("SELECT o_orderpriority, round(stddev_pop(o_totalprice)/avg(o_totalprice),6) AS cv FROM orders GROUP BY 1")
def sk10_variation(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(r6(G.coefficient_of_variation("o_totalprice"), "cv"))


@R.add(
    """WITH s AS (SELECT *, unnest(['global','operator/'||l_linestatus]) AS scope FROM lineitem), g AS (SELECT l_returnflag, scope, count(*) AS matrices, sqrt(sum(l_quantity*l_quantity)) AS b, sqrt(sum(l_extendedprice*l_extendedprice)) AS a, sqrt(sum(l_discount*l_discount)) AS d, quantile_cont(l_discount/l_quantity,0.5) AS m, quantile_cont(l_discount/l_quantity,0.75)-quantile_cont(l_discount/l_quantity,0.25) AS i FROM s GROUP BY ALL)
SELECT l_returnflag, scope, matrices, round(b,6) AS before, round(a,6) AS after, round(d,6) AS delta, round((a-b)/b,6) AS norm_change, round(d/b,6) AS relative_change, round(m,6) AS median_change, round(i,6) AS iqr_change FROM g"""
)
def ex1_scoped_changes(spark, sf):
    return rounded(G.scoped_changes(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount"), "l_returnflag", "scope")


@R.add("SELECT 150::BIGINT AS n, 2::BIGINT AS epochs, 150::BIGINT AS places")
def sc6_cursor_scan(spark, sf):
    """150 rows from the middle of an epoch on: all different places, of two epochs."""
    d = table(spark, sf, "documents").select("doc_id")
    n = d.count()
    found = L.cursor_scan(d, "doc_id", n - 70, 150, 3, n)
    return found.agg(F.count("*").alias("n"), F.count_distinct("epoch").alias("epochs"), F.count_distinct("epoch", "epoch_pos").alias("places"))


@R.add("SELECT event_id, event_type='click' AS from_buffer FROM (SELECT *, row_number() OVER (ORDER BY event_type='click' DESC, event_id) AS n FROM events) WHERE n<=400")
def sc8_buffer_first(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return L.buffer_first(e.filter("event_type = 'click'"), e.filter("event_type <> 'click'"), "event_id", 400).select("event_id", "from_buffer")


@R.add("SELECT conv_id, CASE WHEN count(*)>0 THEN list_sort(list(role) FILTER (WHERE role<>'system' AND length(role)<=6)) END AS kept FROM (SELECT DISTINCT conv_id, role FROM conversations) GROUP BY 1")
def sc14_compact_metadata(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "role").distinct().groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", F.col("role").alias("v")))).alias("m"))
    return c.select("conv_id", F.array_sort(F.map_keys(D.compact_metadata(F.col("m"), ["system"], 6)[0])).alias("kept"))


@R.add("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id)-1 AS p FROM documents) SELECT event_id, doc_id FROM events JOIN d ON p=user_id")
def sc20_fetch_by_position(spark, sf):
    corpus = D.read_records(spark, f"{sf}/documents.parquet").select("row_pos", "doc_id")
    return L.fetch_by_position(corpus, table(spark, sf, "events").select("event_id", F.col("user_id").alias("row_pos"))).select("event_id", "doc_id")


@R.add("SELECT vec_id, (len(embedding)-vec_id%7)::INT AS response_length, round(len(list_filter(embedding, lambda x, i: i>vec_id%7)),6)::INT AS masked, 0.0::DOUBLE AS reward FROM embeddings")
def sc22_supervised_feed(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("loss_mask", F.transform("embedding", lambda x, i: (i >= F.col("vec_id") % 7).cast("int")))
    return L.supervised_feed(e, "embedding", "loss_mask").select("vec_id", "response_length", F.size("loss_mask").alias("masked"), "reward")


@R.add("SELECT o_orderkey, list_sort([o_orderkey::VARCHAR, 'p','q','r']) AS choices, true AS labelled FROM orders")
def ex7_choice_rows(spark, sf):
    made = B.choice_row(F.col("o_orderkey"), F.lit("which? "), F.col("o_orderkey").cast("string"), [F.lit("p"), F.lit(" q"), F.lit("r")], 7)
    o = table(spark, sf, "orders").select("o_orderkey", made.alias("m"))
    marked = F.contains("m.prompt", F.concat(F.lit("\n"), F.col("m.label"), F.lit(") "), F.col("o_orderkey").cast("string")))
    return o.select("o_orderkey", F.array_sort("m.choices").alias("choices"), marked.alias("labelled"))


@R.add("SELECT item_id, 'Solve: '||text AS content, item_id::VARCHAR AS label, 'given' AS data_source, item_id%5 AS level FROM benchmark")
def ex8_math_rows(spark, sf):
    made = B.math_row(F.col("text"), F.format_string(" %d ", "item_id"), "Solve: ", "given", level=F.col("item_id") % 5)
    return table(spark, sf, "benchmark").select("item_id", made.alias("m")).select("item_id", F.col("m.prompt")[0]["content"].alias("content"), "m.label", "m.data_source", "m.metadata.level")


@R.add("SELECT o_orderkey, o_orderkey::VARCHAR AS label FROM orders")
def ex9_boxed_label(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", L.boxed_label(F.format_string(" \\boxed{%d} ", "o_orderkey")).alias("label"))


@R.add("SELECT url||suffix AS link FROM pages, (VALUES (''),('.html'),('.pdf'),('/x.SHTML')) t(suffix) WHERE page_id%3<>0 AND regexp_extract(url||suffix,'[^/.][^/]*(\\.[^/.]*)$',1) IN ('','.html','.htm','.shtml')")
def ex11_page_links(spark, sf):
    mime = F.when(F.col("page_id") % 3 == 0, "application/pdf")
    items = F.array(*[F.struct(F.concat("url", F.lit(s)).alias("link"), mime.alias("mime")) for s in ("", ".html", ".pdf", "/x.SHTML")])
    return B.page_links(table(spark, sf, "pages").select(items.alias("items")), "items")


@R.add("SELECT conv_id, turn, turn*CASE role WHEN 'user' THEN 0.5::DOUBLE WHEN 'assistant' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS reward FROM conversations")
def ex12_scaled_by_role(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", B.scaled_by_role(F.col("turn"), F.col("role"), {"user": 0.5, "assistant": 2.0}).alias("reward"))


@R.add("SELECT o_orderkey, round(3.0::DOUBLE*o_totalprice/nullif(o_custkey%3,0),6) AS tflops, round(o_shippriority_like/nullif(o_custkey%3,0),6) AS tok_per_s, (o_custkey%3+o_orderkey%5)::DOUBLE AS step_time, round((o_orderkey%5)::DOUBLE/nullif(o_custkey%3+o_orderkey%5,0),6) AS wait_time_ratio FROM (SELECT *, (o_orderkey%100)::DOUBLE AS o_shippriority_like FROM orders) WHERE o_custkey%3+o_orderkey%5>0")
def ex14_performance(spark, sf):
    o = table(spark, sf, "orders").withColumn("train", (F.col("o_custkey") % 3).cast("double")).withColumn("wait", (F.col("o_orderkey") % 5).cast("double"))
    p = B.performance(F.col("o_totalprice"), (F.col("o_orderkey") % 100).cast("double"), {"actor_train": F.col("train"), "train": F.col("train"), "train_wait": F.col("wait")})
    return o.select("o_orderkey", r6(p["actor_train_tflops"], "tflops"), r6(p["actor_train_tok_per_s"], "tok_per_s"), p["step_time"].alias("step_time"), r6(p["wait_time_ratio"], "wait_time_ratio")).filter("step_time > 0")


@R.add("SELECT event_id, CASE WHEN event_id%2=0 THEN 1 ELSE 2 END::INT AS n, 'r.type' AS first FROM events")
def ex15_request_attributes(spark, sf):
    value = F.when(F.col("event_id") % 2 == 1, F.col("event_type"))
    meta = F.create_map(F.lit("type"), F.lit("x"), F.lit("value"), value, F.lit("other"), F.lit("y"))
    return table(spark, sf, "events").select("event_id", B.request_attributes(meta, ["type", "value"], "r.").alias("m")).select("event_id", F.size("m").alias("n"), F.array_min(F.map_keys("m")).alias("first"))


@R.add("WITH r AS (SELECT event_type, avg(value) AS u, count(*) AS s FROM events GROUP BY 1) SELECT round(min(u),6) AS low, round(max(u),6) AS high, min(s) AS shortest, max(s) AS longest, round(max(u)-min(u),6) AS spread, max(u)-min(u)>5 AS imbalanced FROM r")
def ex16_rank_balance(spark, sf):
    ranks = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("u"), F.count("*").alias("s"))
    return rounded(B.rank_balance(ranks, "u", "s"))


@R.add("SELECT vec_id, len(list_filter(embedding, lambda x: x>0))::INT AS passed, len(embedding)::INT AS total FROM embeddings")
def ex17_test_counts(spark, sf):
    good, bad = F.filter("embedding", lambda x: x > 0), F.filter("embedding", lambda x: x <= 0)
    return table(spark, sf, "embeddings").select("vec_id", B.test_counts(good, bad).alias("t")).select("vec_id", "t.*")


@R.add("SELECT vec_id, len(list_filter(embedding, lambda x: x>0))::INT AS n, list_filter(embedding, lambda x: x>0)::DOUBLE[] AS changed FROM embeddings")
def ex18_changed_positions(spark, sf):
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", B.changed_positions(e, F.transform(e, lambda x: x > 0)).alias("c")).select("vec_id", F.col("c.count").alias("n"), F.col("c.values").alias("changed"))


@R.add("SELECT o_orderkey, unnest(list_filter(['large price', 'open'], lambda m: (m='large price' AND o_totalprice>=200000) OR (m='open' AND o_orderstatus='O'))) AS message FROM orders")
def ex3_violations(spark, sf):
    return B.violations(table(spark, sf, "orders"), "o_orderkey", {"large price": F.col("o_totalprice") < 200000, "open": F.col("o_orderstatus") != "O"})


@R.add(
    """WITH r AS (SELECT o_orderkey AS run, CASE WHEN o_orderstatus='F' THEN 'complete' WHEN o_orderkey%5=0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey%3<>0 THEN o_orderpriority ELSE ' ' END AS seed FROM orders),
s AS (SELECT l_orderkey AS run, l_linestatus AS stream, l_linenumber AS step, count(*) AS n, sum(l_partkey) AS d FROM lineitem GROUP BY ALL), f AS (SELECT run, stream, sum(n) AS found, max(n) AS most, count(*) AS steps, max(step)-min(step)+1 AS span, sum(d) AS is_ FROM s GROUP BY ALL),
d AS (SELECT o_orderkey AS run, 'O' AS stream, o_orderkey%4+1 AS "rows", (SELECT sum(l_partkey) FROM lineitem WHERE l_orderkey=o_orderkey AND l_linestatus='O')+o_orderkey%2 AS should FROM orders),
b AS (SELECT coalesce(d.run, f.run) AS run, coalesce(d.stream, f.stream) AS stream, "rows", should, found, most, steps, span, is_ FROM d FULL JOIN f ON f.run=d.run AND f.stream=d.stream),
m AS (SELECT run, stream, unnest(list_filter([CASE WHEN found IS NULL THEN 'no rows' END, CASE WHEN "rows" IS NULL THEN 'not declared' END, CASE WHEN found<>"rows" THEN found||' rows, '||"rows"||' are declared' END,
 CASE WHEN found IS NOT NULL AND "rows" IS NOT NULL AND is_ IS DISTINCT FROM should THEN 'digest differs' END, CASE WHEN most>1 THEN 'steps repeat' END, CASE WHEN steps<span THEN 'steps have gaps' END], lambda x: x IS NOT NULL)) AS m FROM b WHERE run IN (SELECT run FROM r))
SELECT run, stream||': '||m AS message FROM m UNION ALL SELECT run, 'missing seed' FROM r WHERE trim(seed)='' UNION ALL SELECT run, 'missing model' FROM r UNION ALL SELECT run, 'status is '||coalesce(status,'missing') FROM r WHERE status IS DISTINCT FROM 'complete'"""
)
def ex3_run_errors(spark, sf):
    """Orders as runs and their lines as events in two streams, of which only open lines were declared, most of them wrongly."""
    o, l, k = table(spark, sf, "orders"), table(spark, sf, "lineitem"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(k % 5 != 0, F.col("o_orderstatus"))
    runs = o.select(k.alias("run"), status.alias("status"), F.create_map(F.lit("seed"), F.when(k % 3 != 0, F.col("o_orderpriority")).otherwise(" ")).alias("fields"))
    events = l.select(F.col("l_orderkey").alias("run"), F.col("l_linestatus").alias("stream"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("digest"))
    sums = events.filter("stream = 'O'").groupBy("run").agg(F.sum("digest").alias("d"))
    declared = o.join(sums, F.col("run") == k, "left").select(k.alias("run"), F.lit("O").alias("stream"), (k % 4 + 1).alias("rows"), (F.col("d") + k % 2).alias("digest"))
    return B.run_errors(runs, events, declared, ["seed", "model"])
