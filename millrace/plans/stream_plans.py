"""Streams that read a given table to its end, and record sources and sinks that write below the shared folder and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as T
from ..operators import groups as G
from ..operators import ordered as O
from ..operators import sketches as K
from ..operators.containment import contained_items
from ..operators.geometry import principal_angles
from ..operators.lineage import fresh_folder
from ..operators.trajectories import TURN
from ..sources import queue as Q
from ..sources import records as D
from ..sources import rollouts as S
from ..streaming import buffers as U
from ..streaming import groups as B
from ..streaming import rollouts as L
from .base import TOKENS, Registry, r6, table, tokens
from .token_plans import digest, digested

R = Registry()


def streamed(spark, sf: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")  # as a pattern: a file or a folder


def ran(stream: DataFrame, sink, place: str) -> None:
    """To the end of what is there now."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def collected(spark, stream: DataFrame) -> DataFrame:
    place = fresh_folder(spark, "stream")
    ran(stream, B.idempotent_sink(f"{place}/out"), place)
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def left(spark, stream: DataFrame, sink) -> DataFrame:
    """What a sink of groups, made by `sink` for a folder, lets go."""
    place = fresh_folder(spark, "stream")
    ran(stream, sink(place), place)
    return spark.read.parquet(f"{place}/out")


@R.add("SELECT event_type, count(*)//4 AS complete, (count(*)//4)*4 AS members FROM events GROUP BY 1")
def st1_complete_groups(spark, sf):
    out = collected(spark, B.complete_groups(streamed(spark, sf, "events").select("event_type", "event_id"), "event_type", 4, "event_id"))
    return out.groupBy("event_type").agg(F.count("*").alias("complete"), F.sum(F.size("members")).alias("members"))


@R.add("SELECT user_id, count(*)//3 AS complete, count(DISTINCT event_id)//3*3 AS members FROM events GROUP BY 1 HAVING count(*)>=3")
def st3_drained_buffer(spark, sf):
    """What was read has left the buffer: no member comes twice."""
    out = collected(spark, B.complete_groups(streamed(spark, sf, "events").select("user_id", "event_id"), "user_id", 3, "event_id"))
    each = out.select("user_id", F.explode("members").alias("m")).distinct().groupBy("user_id").agg(F.count("*").alias("members"))
    return out.groupBy("user_id").agg(F.count("*").alias("complete")).join(each, "user_id")


WAIT_MS = 4 * 3600 * 1000


@R.add(
    f"""WITH g AS (SELECT user_id, count(*)::INT AS n, round(avg(value),6) AS reward_mean, min(ts) AS first_time, max(ts) AS last_time FROM events GROUP BY 1)
SELECT user_id, n, reward_mean, epoch_us(first_time) AS first_us, epoch_us(last_time) AS last_us, n<12 AS timed_out FROM g WHERE n>=12 OR epoch_ms(last_time)+{WAIT_MS} <= (SELECT epoch_ms(max(ts)) FROM events)-60000"""
)
def st2_groups_with_meta(spark, sf):
    """Users with 12 events leave whole, others once the watermark, a minute behind, has passed their last event by the waiting time."""
    U.use_rocksdb(spark)
    stream = streamed(spark, sf, "events").select("user_id", "event_id", F.col("value").alias("reward"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 minute")
    out = collected(spark, U.buffered_groups(stream, "user_id", 12, WAIT_MS))
    return out.select("user_id", "n", r6(F.col("reward_mean"), "reward_mean"), F.unix_micros("first_time").alias("first_us"), F.unix_micros("last_time").alias("last_us"), "timed_out")


@R.add("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def sc21_record_queue(spark, sf):
    """Orders are written to a queue, streamed from there into another, and read back from that."""
    place = fresh_folder(spark, "queue")
    spark.dataSource.register(Q.RecordQueue)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    for part in range(3):
        o.filter(F.pmod("o_orderkey", F.lit(3)) == part).write.format("record_queue").mode("append").save(f"{place}/in")
    stream = spark.readStream.format("record_queue").option("path", f"{place}/in").load().select("record")
    stream.writeStream.format("record_queue").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    r = F.from_json("record", "o_orderkey bigint, o_custkey bigint, o_orderstatus string").alias("r")
    return Q.queue_records(spark, f"{place}/out").select(r).select("r.*")


def groups_taken(spark, sf, which: str) -> DataFrame:
    place = fresh_folder(spark, "stream")
    o = streamed(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, "aborted").otherwise("completed").alias("status"))
    ran(o, L.take_groups(place, "o_custkey", "o_orderkey", 100, "status"), place)
    return spark.read.parquet(f"{place}/{which}").select("o_custkey", "o_orderkey")


TAKEN = "WITH g AS (SELECT o_custkey, bool_or(o_orderkey%97=0) AS aborted, min(o_orderkey) AS arrival FROM orders GROUP BY 1), t AS (SELECT o_custkey FROM g WHERE NOT aborted ORDER BY arrival, o_custkey LIMIT 100) SELECT o_custkey, o_orderkey FROM orders "


@R.add(TAKEN + "WHERE o_custkey IN (SELECT o_custkey FROM t)")
def st5_taken_groups(spark, sf):
    return groups_taken(spark, sf, "taken")


@R.add(TAKEN + "WHERE o_custkey IN (SELECT o_custkey FROM g WHERE aborted)")
def st6_requeued_groups(spark, sf):
    return groups_taken(spark, sf, "requeue")


@R.add(TAKEN + "WHERE o_custkey NOT IN (SELECT o_custkey FROM t) AND o_custkey IN (SELECT o_custkey FROM g WHERE NOT aborted)")
def st7_carried_groups(spark, sf):
    return groups_taken(spark, sf, "carry")


@R.add("SELECT event_id//4 AS request_id, string_agg(event_type,'' ORDER BY event_id) AS text, 4 AS chunks, max(user_id) FILTER (event_id%4=3)::VARCHAR AS last FROM events GROUP BY 1 HAVING count(*)=4")
def st8_folded_chunks(spark, sf):
    e = streamed(spark, sf, "events").select(
        F.floor(F.col("event_id") / 4).alias("request_id"), (F.col("event_id") % 4).cast("int").alias("seq"), F.col("event_type").alias("text"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"), F.when(F.col("event_id") % 4 == 3, "stop").alias("finish_reason"),
    )
    return left(spark, e, L.whole_answers).select("request_id", "text", F.col("chunks").cast("int").alias("chunks"), F.col("metadata")["user"].alias("last"))


@R.add("SELECT a.event_id//2 AS span, epoch_us(b.ts)-epoch_us(a.ts) AS micros FROM events a JOIN events b ON b.event_id=a.event_id+1 AND a.event_id%2=0 WHERE b.ts>=a.ts AND b.ts<=a.ts+INTERVAL 1 HOUR")
def st9_joined_spans(spark, sf):
    half = lambda k: streamed(spark, sf, "events").filter(F.col("event_id") % 2 == k).select(F.floor(F.col("event_id") / 2).alias("span"), F.col("ts").cast("timestamp").alias("ts"))
    return collected(spark, L.joined_spans(half(0), half(1), "span", late="10000 days")).select("span", "micros")


@R.add("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def st10_committed_metrics(spark, sf):
    place = fresh_folder(spark, "stream")
    ran(streamed(spark, sf, "events").select("event_type", "value"), L.committed_sink(place), place)
    spark.range(5).select(F.lit("lost").alias("event_type"), F.lit(0.0).alias("value")).write.parquet(f"{place}/rows/batch=1000000")  # never committed
    return L.committed_rows(spark, place).groupBy("event_type").agg(F.count("*").alias("n"))


@R.add("SELECT event_id, 0 AS row, [event_id::INT%7, 9] AS tokens, 1 AS response_length FROM events WHERE event_id%3=0")
def st11_finished_sessions(spark, sf):
    """One turn a session; those that don't end are carried on."""
    p = F.array((F.col("event_id") % 7).cast("int"))
    turn = [F.array(F.struct(F.lit("user").alias("role"), F.col("event_type").alias("content"))), F.lit("a"), p, F.array(F.lit(9)), F.array(F.lit(-1.0)), F.lit("stop"), F.lit(False), F.lit(False)]
    names = [c.split()[0] for c in TURN.split(", ")]
    e = streamed(spark, sf, "events").select("event_id", F.lit(1).alias("number"), *[c.alias(n) for c, n in zip(turn, names)], (F.col("event_id") % 3 == 0).alias("ended"))
    return left(spark, e, lambda place: L.ended_sessions(place, "event_id", "number", "ended")).select("event_id", "row", "tokens", "response_length")


# sources and sinks


@R.add("SELECT p_partkey, p_name FROM part")
def sc4_strict_records(spark, sf):
    place = fresh_folder(spark, "records") + "/rows.jsonl"
    table(spark, sf, "part").select("p_partkey", "p_name").write.json(place)
    return D.read_records(spark, place, "p_partkey bigint, p_name string", strict=True).select("p_partkey", "p_name")


@R.add("SELECT count(*) AS offset, 7::BIGINT AS group_index, 28::BIGINT AS index FROM documents")
def sc7_restored_cursor(spark, sf):
    place, n = fresh_folder(spark, "cursor"), table(spark, sf, "documents").count()
    S.save_cursor(spark, place, 3, 0, 0, 0)
    S.save_cursor(spark, place, 3, n, 7, 28)
    return spark.createDataFrame([S.restored_cursor(spark, place, 3)], "offset bigint, group_index bigint, index bigint")


@R.add("SELECT o_orderkey, i AS copy FROM orders, (SELECT unnest(range(0,4))::INT AS i)")
def sc9_requeued_groups(spark, sf):
    from ..operators.selection import fanned_out

    return S.checked_groups(fanned_out(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 4), "group_index", 4).select("o_orderkey", "copy")


@R.add("SELECT r_name AS name, '/data/'||lower(r_name)||'.jsonl' AS path, 1.0+r_regionkey::DOUBLE AS weight FROM region")
def sc10_manifest(spark, sf):
    rows = table(spark, sf, "region").collect()  # a manifest is written by hand and small
    text = json.dumps({"sources": [{"name": r["r_name"], "path": r["r_name"].lower() + ".jsonl", "weight": 1 + r["r_regionkey"]} for r in rows]})
    return S.manifest(spark, text, "/data/")


@R.add("SELECT event_id, event_type, value FROM events")
def sc11_dumped_rollout(spark, sf):
    place = fresh_folder(spark, "dump")
    S.dump_rollout(table(spark, sf, "events").select("event_id", "event_type", "value"), place, 5)
    S.dump_rollout(table(spark, sf, "events").limit(3), place, 6)
    return S.replay_rollout(spark, place, 5)


@R.add("SELECT source AS dataset, count(*) AS rows FROM documents WHERE source IS NOT NULL GROUP BY 1")
def sc13_evaluation_artifact(spark, sf):
    d = table(spark, sf, "documents").filter("source is not null")
    rows = d.select(F.col("source").alias("dataset"), "doc_id", F.create_map(F.lit("test"), F.col("text"), F.lit("lang"), F.col("lang")).alias("metadata"))
    place = fresh_folder(spark, "evaluation")
    S.save_evaluation(rows, place, 2)
    return spark.read.json(f"{place}/index_2").select("dataset", "rows")


@R.add("SELECT event_id, CASE WHEN event_id%3=0 THEN value END AS value FROM events")
def sc15_json_safe(spark, sf):
    n = F.col("event_id") % 3
    return table(spark, sf, "events").select("event_id", D.json_safe(F.when(n == 0, F.col("value")).when(n == 1, float("nan")).otherwise(float("-inf"))).alias("value"))


@R.add("SELECT 'rollout' AS namespace, 4::BIGINT AS step, 'rollout/rows' AS metric, count(*)::DOUBLE AS value FROM events UNION ALL SELECT 'train', 4, 'train/rows', count(*) FROM orders")
def sc16_metric_events(spark, sf):
    place = fresh_folder(spark, "metrics")
    S.append_metrics(spark, place, "step", {"step": 4, "rollout/rows": table(spark, sf, "events").count()})
    S.append_metrics(spark, place, "step", {"step": 4, "train/rows": table(spark, sf, "orders").count()})
    return spark.read.schema("namespace string, step bigint, metric string, value double").json(place).select("namespace", "step", "metric", "value")


@R.add("SELECT true AS first, false AS again, count(*) AS rows FROM part")
def sc17_published_once(spark, sf):
    place, rows = fresh_folder(spark, "published"), table(spark, sf, "part").select("p_partkey", "p_name")
    first, again = S.publish_once(rows, place), S.publish_once(rows.orderBy(F.desc("p_partkey")), place)
    return spark.read.parquet(place).agg(F.count("*").alias("rows")).select(F.lit(first).alias("first"), F.lit(again).alias("again"), "rows")


@R.add("SELECT n_name, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT NULL, r_name FROM region")
def sc18_csv_union(spark, sf):
    place = fresh_folder(spark, "csv")
    D.write_csv_union([table(spark, sf, "region").select("r_name"), table(spark, sf, "nation").select("n_name")], place)
    return spark.read.schema("n_name string, r_name string").option("header", True).csv(place)


@R.add("SELECT event_type AS name, count(*) AS n, sum(user_id)::DOUBLE AS dur FROM events GROUP BY 1")
def sc19_trace_events(spark, sf):
    place = fresh_folder(spark, "trace")
    e = table(spark, sf, "events").select("event_type", F.struct(F.col("event_type").alias("name"), F.lit("X").alias("ph"), F.col("event_id").cast("double").alias("ts"), F.col("user_id").cast("double").alias("dur")).alias("e"))
    traces = e.groupBy("event_type", F.pmod(F.col("e.ts"), F.lit(16)).alias("part")).agg(F.collect_list("e").alias("traceEvents"))
    traces.write.partitionBy("event_type", "part").option("compression", "gzip").json(place)
    return S.trace_events(spark, place + "/*/*").groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("dur"), 3).alias("dur"))


@R.add("SELECT count(*) AS lines FROM part")
def ex4_file_records(spark, sf):
    place = fresh_folder(spark, "files")
    table(spark, sf, "part").select("p_partkey", "p_name").coalesce(1).write.json(place)
    return S.file_records(spark, place).agg(F.sum("lines").alias("lines"))


@R.add("SELECT 1::BIGINT AS files, true AS same")
def ex6_folder_fingerprint(spark, sf):
    place = fresh_folder(spark, "files")
    table(spark, sf, "region").coalesce(1).write.parquet(place)
    one = lambda: S.folder_fingerprint(spark, place + "/*.parquet")
    again = one().select(F.col("fingerprint").alias("again"))
    return one().join(F.broadcast(again)).select("files", (F.col("fingerprint") == F.col("again")).alias("same"))  # one row each


@R.add("SELECT count(*) AS rows FROM nation")
def ex10_expected_rows(spark, sf):
    place, rows = fresh_folder(spark, "guarded"), table(spark, sf, "nation")
    S.expected_rows(rows, place, rows.count())
    return spark.read.parquet(place).agg(F.count("*").alias("rows"))


@R.add("SELECT o_orderkey, m AS message FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice<=100000 THEN 'the price must exceed 100000' END, CASE WHEN o_orderstatus<>'F' THEN 'the order must be closed' END], lambda x: x IS NOT NULL)) AS m FROM orders)")
def ex5_config_violations(spark, sf):
    from ..operators.benchmarks import violations

    rules = {"the price must exceed 100000": F.col("o_totalprice") > 100000, "the order must be closed": F.col("o_orderstatus") == "F"}
    return violations(table(spark, sf, "orders"), "o_orderkey", rules)


# pieces that had no query of their own


@R.add(
    """WITH s AS (SELECT label, [embedding[1]::DOUBLE, embedding[2]::DOUBLE] AS a, [embedding[3]::DOUBLE+0.5*embedding[1], embedding[4]::DOUBLE-0.3*embedding[2]] AS b FROM embeddings),
g AS (SELECT label, sum(a[1]*a[1]) AS p, sum(a[1]*a[2]) AS q, sum(a[2]*a[2]) AS r, sum(b[1]*b[1]) AS u, sum(b[1]*b[2]) AS v, sum(b[2]*b[2]) AS w, sum(a[1]*b[1]) AS c11, sum(a[1]*b[2]) AS c12, sum(a[2]*b[1]) AS c21, sum(a[2]*b[2]) AS c22 FROM s GROUP BY 1),
h AS (SELECT *, p*r-q*q AS da, u*w-v*v AS db FROM g),
m AS (SELECT label, (r*c11-q*c21)/da AS x11, (r*c12-q*c22)/da AS x12, (p*c21-q*c11)/da AS x21, (p*c22-q*c12)/da AS x22, (w*c11-v*c12)/db AS y11, (u*c12-v*c11)/db AS y12, (w*c21-v*c22)/db AS y21, (u*c22-v*c21)/db AS y22 FROM h),
t AS (SELECT label, x11*y11+x12*y12+x21*y21+x22*y22 AS trace, (x11*x22-x12*x21)*(y11*y22-y12*y21) AS det FROM m),
l AS (SELECT label, degrees(acos(sqrt(least(1, (trace+sqrt(greatest(0,trace*trace-4*det)))/2)))) AS near, degrees(acos(sqrt(greatest(0, (trace-sqrt(greatest(0,trace*trace-4*det)))/2)))) AS far FROM t)
SELECT label, round(far,4) AS max_deg, round((near+far)/2,4) AS mean_deg FROM l"""
)
def ex2_principal_angles(spark, sf):
    """Of the planes that two pairs of components span over all vectors of a label."""
    e = F.col("embedding").cast("array<double>")
    columns = F.array(e[0], e[1]).alias("a"), F.array(e[2] + 0.5 * e[0], e[3] - 0.3 * e[1]).alias("b")
    return principal_angles(table(spark, sf, "embeddings").select("label", *columns), "label", "a", "b").select("label", F.round("max_deg", 4).alias("max_deg"), F.round("mean_deg", 4).alias("mean_deg"))


@R.add(
    f"WITH {TOKENS}, e AS (SELECT vec_id, i, x+0.99*coalesce(lead(base) OVER (PARTITION BY vec_id ORDER BY i),0.0)-base AS dl FROM tok), d AS (SELECT a.vec_id, a.i, sum(b.dl*pow(0.99*0.95,b.i-a.i)) AS adv FROM e a JOIN e b ON a.vec_id=b.vec_id AND b.i>=a.i GROUP BY ALL) "
    + digested("adv", source="d")
)
def wn12_chunked_gae(spark, sf):
    return digest(tokens(spark, sf), T.gae(F.col("x"), F.col("base"), 0.99, 0.95, chunk=7))


@R.add("SELECT event_type, round(sum(auc)/nullif(max(event_id)-min(event_id),0),6) AS normalized_auc FROM (SELECT event_type, event_id, (value+lag(value) OVER w)/2*(event_id-lag(event_id) OVER w) AS auc FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) GROUP BY 1")
def wn2_normalised_area(spark, sf):
    return O.curve_area(table(spark, sf, "events"), ["event_type"], "event_id", "value").select("event_type", r6(F.col("normalized_auc"), "normalized_auc"))


@R.add("SELECT l_orderkey, CASE WHEN n-c<2 THEN 1.0 WHEN c=0 THEN 0.0 ELSE 1-(n-c)*(n-c-1)/(n*(n-1.0)) END::DOUBLE AS p FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag='R') AS c FROM lineitem GROUP BY 1) WHERE n>=2")
def ag3_pass_estimate(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("c")).filter("n >= 2")
    return g.select("l_orderkey", r6(G.pass_at_k(F.col("n"), F.col("c"), 2), "p"))


@R.add("WITH f AS (SELECT DISTINCT item_id, lower(trim(regexp_replace(text,'\\s+',' ','g'))) AS t FROM benchmark) SELECT item_id, count(*) AS documents FROM documents JOIN f ON contains(lower(trim(regexp_replace(text,'\\s+',' ','g'))), t) GROUP BY 1")
def jn4_documents_of_items(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.collapsed(F.col("text")).alias("text"))
    b = table(spark, sf, "benchmark").select("item_id", X.collapsed(F.col("text")).alias("text")).distinct()
    return contained_items(d, b).distinct().groupBy("item_id").agg(F.count("*").alias("documents"))


@R.add("SELECT event_id, xor(c, c >> 16) AS mixed FROM (SELECT event_id, (xor(b, b >> 15)::HUGEINT * 2221713035 % 4294967296)::BIGINT AS c FROM (SELECT event_id, (xor(a, a >> 16)::HUGEINT * 2146121005 % 4294967296)::BIGINT AS b FROM (SELECT event_id, (event_id+9)::BIGINT AS a FROM events)))")
def sk2_mixed(spark, sf):
    return table(spark, sf, "events").select("event_id", K.mixed32(F.col("event_id"), 9).alias("mixed"))


@R.add("SELECT status, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN 'meta' ELSE 'unknown' END AS status FROM orders) GROUP BY 1")
def pf12_row_source(spark, sf):
    """The row's own attribute, then its metadata, else unknown; blanks become underscores in the label."""
    own, meta = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")), F.when(F.col("o_orderstatus") == "O", "meta")
    return table(spark, sf, "orders").groupBy(F.replace(X.source_label(own, meta), F.lit("_"), F.lit(" ")).alias("status")).agg(F.count("*").alias("n"))


@R.add("SELECT event_type AS source, count(*) AS at FROM events GROUP BY 1")
def sl9_restored_sampler(spark, sf):
    place, config = fresh_folder(spark, "sampler"), {"seed": 7, "mode": "weighted"}
    counts = table(spark, sf, "events").groupBy("event_type").count().collect()  # one for each source
    S.save_sampler(spark, place, config, {r["event_type"]: r["count"] for r in counts})
    return spark.createDataFrame(sorted(S.restored_sampler(spark, place, config).items()), "source string, at bigint")


@R.add("SELECT doc_id, md5('<|im_start|>user'||chr(10)||text||'<|im_end|>'||chr(10)||'<|im_start|>assistant'||chr(10)) AS prompt, lang AS label, source AS metadata FROM documents")
def sc3_dataset_rows(spark, sf):
    from ..functions.samples import dataset_row

    row = dataset_row(F.col("text"), F.col("lang"), F.create_map(F.lit("source"), F.col("source"))).alias("r")
    return table(spark, sf, "documents").select("doc_id", row).select("doc_id", F.md5("r.prompt").alias("prompt"), F.col("r.label").alias("label"), F.col("r.metadata")["source"].alias("metadata"))
