"""Sampling, holdout, slices and top-k over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import selection as S
from .base import Registry, r6, table

R = Registry()


@R.add("SELECT o_orderkey, i::BIGINT AS index FROM (SELECT o_orderkey, unnest(range(0,4)) AS c FROM orders) t, LATERAL (SELECT o_orderkey*4+c AS i)")
def sl2_fan_out(spark, sf):
    return S.fanned_out(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 4).select("o_orderkey", "index")


def hashed(seed: int, key: str) -> str:
    """The keyed hash in SQL."""
    return f"('0x'||substr(md5('{seed}:'||{key}),1,15))::BIGINT"


@R.add(f"SELECT doc_id, row_number() OVER (ORDER BY {hashed(45, 'doc_id')}, doc_id)-1 AS epoch_pos FROM documents")
def sl1_epoch_order(spark, sf):
    return S.epoch_order(table(spark, sf, "documents").select("doc_id"), "doc_id", 42, 3).select("doc_id", "epoch_pos")


@R.add("SELECT ['math','code','chat'][(event_id%3)+1] AS source, count(*) AS n FROM events GROUP BY 1")
def sl5_round_robin(spark, sf):
    names = F.array(*map(F.lit, ["math", "code", "chat"]))
    return table(spark, sf, "events").groupBy(F.get(names, F.pmod("event_id", F.lit(3)).cast("int")).alias("source")).agg(F.count("*").alias("n"))


@R.add("SELECT CASE WHEN event_id%1000<100 THEN 'easy' WHEN event_id%1000<400 THEN 'mid' ELSE 'hard' END AS source, count(*) AS n FROM events GROUP BY 1")
def sl6_curriculum(spark, sf):
    source = S.curriculum([("easy", 100), ("mid", 300), ("hard", 600)], F.col("event_id"), repeat=True)
    return table(spark, sf, "events").groupBy(source.alias("source")).agg(F.count("*").alias("n"))


@R.add("WITH l AS (SELECT event_type, count(*)%7+3 AS length FROM events GROUP BY 1), r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id)-1 AS n FROM events) SELECT event_id, n//length AS epoch, n%length AS position FROM r JOIN l USING (event_type)")
def sl10_source_cursor(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id")
    lengths = e.groupBy(F.col("event_type").alias("source")).agg((F.count("*") % 7 + 3).alias("length"))
    return S.source_cursor(e, "event_type", "event_id", lengths).select("event_id", "epoch", "position")


@R.add(
    """WITH p AS (SELECT o_orderstatus AS source, o_orderkey FROM orders WHERE o_orderkey%10=0), l AS (SELECT source, count(*) AS length FROM p GROUP BY 1),
r AS (SELECT o_orderkey AS request, o_orderstatus AS source, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)-1 AS n FROM orders), c AS (SELECT request, source, n//length AS epoch, n%length AS position FROM r JOIN l USING (source)),
e AS (SELECT DISTINCT source, epoch FROM c), d AS (SELECT source, epoch, o_orderkey AS prompt, row_number() OVER (PARTITION BY source, epoch ORDER BY md5((11+epoch)||':'||o_orderkey), o_orderkey)-1 AS position FROM p JOIN e USING (source))
SELECT request, source, epoch, position, prompt FROM c JOIN d USING (source, epoch, position)"""
)
def sl10_reshuffled_source(spark, sf):
    """Every order asks its status for a prompt, of which each status has a tenth, so about ten epochs are drawn."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_orderstatus").alias("source"))
    prompts = o.filter("request % 10 = 0").select("source", F.col("request").alias("prompt"))
    return S.source_prompts(o, "source", "request", prompts, "prompt", 11).select("request", "source", "epoch", "position", "prompt")


@R.add(f"SELECT CASE WHEN {hashed(7, 'event_id')}/1152921504606846976.0 < 0.75 THEN 'math' ELSE 'code' END AS source, count(*) AS n FROM events GROUP BY 1")
def sl4_weighted_mixture(spark, sf):
    source = S.chosen_source({"math": 3.0, "code": 1.0, "none": 0.0}, S.draw("event_id", seed=7))
    return table(spark, sf, "events").groupBy(source.alias("source")).agg(F.count("*").alias("n"))


@R.add(
    f"""WITH w AS (SELECT source, count(*) AS weight FROM documents WHERE source IS NOT NULL GROUP BY 1), e AS (SELECT source, (97-(SELECT count(*) FROM w))*weight/(SELECT sum(weight) FROM w)::DOUBLE AS exact FROM w),
r AS (SELECT source, floor(exact)::BIGINT AS sure, row_number() OVER (ORDER BY round(exact-floor(exact),12) DESC, {hashed(3, 'source')}) AS turn FROM e)
SELECT source, (1+sure+(turn <= 97-(SELECT count(*)+sum(sure) FROM r))::INT)::INT AS slots FROM r"""
)
def sl7_stratified(spark, sf):
    w = table(spark, sf, "documents").filter("source is not null").groupBy("source").agg(F.count("*").alias("weight"))
    return S.stratified_slots(w, 97, 3)


@R.add(f"WITH k AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {hashed(5, 'doc_id')}, doc_id) AS turn FROM documents) SELECT lang, doc_id FROM k ORDER BY turn, lang NULLS FIRST LIMIT 100")
def sl11_balanced_subset(spark, sf):
    return S.balanced_subset(table(spark, sf, "documents").select("lang", "doc_id"), "lang", "doc_id", 100, 5)


@R.add(f"SELECT doc_id, row_number() OVER (ORDER BY {hashed(11, 'doc_id')}, doc_id) <= least(50, (SELECT count(*) FROM documents)-1) AS held_out FROM documents")
def sl12_holdout(spark, sf):
    return S.holdout(table(spark, sf, "documents").select("doc_id"), "doc_id", 50, 11)


@R.add("SELECT doc_id FROM documents WHERE doc_id >= (SELECT count(*) FROM documents) - 20")
def sl13_tail_holdout(spark, sf):
    return S.sliced(table(spark, sf, "documents").select("doc_id"), "doc_id", -20, None)


@R.add("SELECT doc_id FROM documents WHERE doc_id >= 10 AND doc_id < (SELECT count(*) FROM documents) - 5")
def sc2_path_slice(spark, sf):
    return S.sliced(table(spark, sf, "documents").select("doc_id"), "doc_id", 10, -5)


@R.add("WITH n AS (SELECT count(*) AS n, floor(count(*)*0.15::DOUBLE)::BIGINT AS k FROM documents) SELECT doc_id FROM documents, n WHERE k=0 OR doc_id < k//2 OR doc_id >= n-(k+1)//2")
def sc12_head_and_tail(spark, sf):
    return S.head_and_tail(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.15)


@R.add("WITH g AS (SELECT o_orderpriority AS value, avg(o_totalprice) AS m, stddev_samp(o_totalprice)/sqrt(count(*)) AS se FROM orders GROUP BY 1), b AS (SELECT m AS bm, se AS bse FROM g ORDER BY m DESC LIMIT 1) SELECT min(value) AS selected FROM g, b WHERE m >= bm - sqrt(bse*bse+se*se)")
def sl14_one_standard_error(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.avg("o_totalprice").alias("m"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count("*"))).alias("se"))
    return S.one_standard_error(g, "value", "m", "se")


@R.add(
    """WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda v: v/sqrt(list_dot_product(e,e))) AS u FROM x),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.u,d.u),9) AS score FROM n q, n d WHERE q.vec_id%50=0)
SELECT query_id, doc_id, round(score,6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank FROM s QUALIFY rank <= 5"""
)
def sl17_dense_top_k(spark, sf):
    e = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x))
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform(e, lambda x: x / norm).alias("vector"))
    out = S.dense_top_k(v.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), v, 5)
    return out.select("query_id", "doc_id", r6(F.col("score"), "score"), "rank")


@R.add(
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text),'[\\p{L}\\p{N}_]+')) AS word FROM documents), q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text),'[\\p{L}\\p{N}_]+')) AS word FROM benchmark),
l AS (SELECT doc_id, count(*) AS len FROM w GROUP BY 1), s AS (SELECT count(*) AS n, avg(len) AS mean FROM l), t AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word IN (SELECT word FROM q) GROUP BY ALL), f AS (SELECT word, count(*) AS df FROM t GROUP BY 1),
c AS (SELECT query_id, doc_id, sum(ln(1+(n-df+0.5)/(df+0.5))*tf/(tf+0.9*(1-0.4+0.4*len/mean))) AS score FROM t JOIN f USING (word) JOIN l USING (doc_id), s, q WHERE q.word=t.word GROUP BY ALL)
SELECT query_id, doc_id, round(score,6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, doc_id))::INT AS rank FROM c QUALIFY rank <= 10"""
)
def sl18_bm25_top_k(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _bm25(q, table(spark, sf, "documents"))


def _bm25(q, docs):
    return S.bm25_top_k(q, docs.select("doc_id", "text"), 10).select("query_id", "doc_id", r6(F.col("score"), "score"), "rank")


@R.add("WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT i, (17+(SELECT min(k) FROM range(7,100) t(k), n WHERE gcd(k,n)=1)*i)%n AS pos FROM range(0,100) t(i), n WHERE i < n) SELECT doc_id, i AS pick FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id)-1 AS pos FROM documents) JOIN s USING (pos)")
def sl20_stride_sample(spark, sf):
    from ..operators.ranking import numbered_by

    d = table(spark, sf, "documents").select("doc_id")
    return S.stride_sample(numbered_by(d, "at", "doc_id"), "at", d.count(), 17, 7, 100).select("doc_id", "pick")


@R.add("SELECT DISTINCT seed FROM (SELECT o_custkey%40 AS seed FROM orders WHERE o_orderpriority='1-URGENT' INTERSECT SELECT o_custkey%40 FROM orders WHERE o_orderpriority='5-LOW')")
def so1_common_seeds(spark, sf):
    o = table(spark, sf, "orders").withColumn("seed", F.col("o_custkey") % 40)
    return M.common_keys(o, "seed", [F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"])


@R.add("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def so3_difference(spark, sf):
    return M.without(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@R.add("SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def so5_duplicate_keys(spark, sf):
    return M.repeated_keys(table(spark, sf, "orders"), ["o_custkey", "o_orderdate"])


@R.add("WITH k AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id*7919%10007, event_id) AS r FROM events) SELECT event_type, event_id FROM k WHERE r<=5")
def sl21_smallest_per_branch(spark, sf):
    return M.smallest_hashes(table(spark, sf, "events"), "event_type", F.col("event_id") * 7919 % 10007, "event_id", 5).select("event_type", "event_id")
