"""Packing of steps, sketches, record reading and the group buffer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packing as P
from ..operators import sketches as K
from ..sources import records as D
from .base import Registry, r6, table

R = Registry()


@R.add("WITH f AS (SELECT l_orderkey, min(l_partkey*100000+l_suppkey*10+l_linenumber) AS first FROM lineitem GROUP BY 1), n AS (SELECT l_orderkey, (row_number() OVER (ORDER BY first, l_orderkey)-1)//32 AS step FROM f) SELECT step::BIGINT AS step, count(DISTINCT l_orderkey) AS rollouts FROM n WHERE step < (SELECT count(*)//32 FROM n) GROUP BY 1")
def pk1_steps(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("position", F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber"))
    return P.steps(df.select("l_orderkey", "position"), "l_orderkey", "position", 32).groupBy("step").agg(F.count_distinct("l_orderkey").alias("rollouts"))


@R.add()
def pk2_packed_steps(spark, sf):
    df = table(spark, sf, "events").select((F.floor(F.col("event_id") / 64)).alias("step"), "event_id", (F.abs(F.col("value")) * 10 + 1).cast("int").alias("length"))
    return P.packed_steps(df, "step", "event_id", "length", 4, 4096)


@R.add("SELECT l_orderkey, round(sum(l_quantity*(2.0*12*(4*1024*1024+3*1024*4096)+2.0*1024*32000)+2.0*12*1024*l_quantity*l_quantity)/1e9,3) AS gflops FROM lineitem GROUP BY 1")
def pk12_forward_flops(spark, sf):
    f = P.forward_flops(F.col("l_quantity").cast("double"), 1024, 12, 4096, 32000)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(f) / 1e9, 3).alias("gflops"))


def entries(spark, sf):
    return table(spark, sf, "embeddings").select("label", "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))


TOK = "e AS (SELECT label, vec_id, generate_subscripts(embedding,1)-1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def mixed(seed: int) -> str:
    return f"(SELECT i, xor(c, c >> 16) AS h FROM (SELECT i, (xor(b, b >> 15)::HUGEINT * 2221713035 % 4294967296)::BIGINT AS c FROM (SELECT i, (xor(a, a >> 16)::HUGEINT * 2146121005 % 4294967296)::BIGINT AS b FROM (SELECT DISTINCT i, (i+{seed})::BIGINT AS a FROM e))))"


@R.add(f"WITH {TOK}, h AS {mixed(5)}, g AS {mixed(6)} SELECT label, (h.h%16)::INT AS bucket, round(sum(CASE WHEN g.h%2=1 THEN v ELSE -v END),6) AS total FROM e JOIN h USING (i) JOIN g USING (i) GROUP BY ALL")
def sk1_count_sketch(spark, sf):
    return K.count_sketch(entries(spark, sf), ["label"], "i", "v", 16, 5).select("label", "bucket", r6(F.col("total"), "total"))


HIST = f"{TOK}, hist AS (SELECT label, CASE WHEN v<>0 THEN greatest(least(floor((log2(abs(v))+149)*4),1107),0)::INT END AS bin, count(*) AS n, sum(v*v) AS energy FROM e GROUP BY ALL)"


@R.add(f"WITH {HIST} SELECT label, bin, n, round(energy,6) AS energy FROM hist")
def sk3_log_histogram(spark, sf):
    return K.histogram(entries(spark, sf), ["label"], "v").select("label", "bin", "n", r6(F.col("energy"), "energy"))


@R.add(f"WITH {HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY bin NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY label) AS total FROM hist), m AS (SELECT label, min(coalesce(bin,-1)) AS b FROM c WHERE upto>=0.9*total GROUP BY 1) SELECT label, round(CASE WHEN b<0 THEN 0 ELSE pow(2.0,(b+0.5)/4-149) END,9) AS quantile FROM m")
def sk4_histogram_quantile(spark, sf):
    q = K.histogram_quantile(K.histogram(entries(spark, sf), ["label"], "v"), ["label"], 0.9)
    return q.select("label", F.round("quantile", 9).alias("quantile"))


@R.add(f"WITH {HIST}, c AS (SELECT *, sum(energy) OVER (PARTITION BY label ORDER BY bin NULLS FIRST) AS upto, sum(energy) OVER (PARTITION BY label) AS total FROM hist), m AS (SELECT label, min(coalesce(bin,-1)) AS b FROM c WHERE upto>=0.5*total GROUP BY 1) SELECT label, round(CASE WHEN b<0 THEN 0 ELSE pow(2.0,(b+0.5)/4-149) END,9) AS quantile FROM m")
def sk5_weighted_quantile(spark, sf):
    """Where half of the energy lies below."""
    q = K.histogram_quantile(K.histogram(entries(spark, sf), ["label"], "v"), ["label"], 0.5, weight="energy")
    return q.select("label", F.round("quantile", 9).alias("quantile"))


@R.add("WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_transform(embedding::DOUBLE[], lambda v: abs(v)) AS b FROM embeddings) SELECT vec_id, round(sqrt(list_dot_product(a,a)),6) AS norm_a, round(sqrt(list_dot_product(b,b)),6) AS norm_b, round(list_dot_product(a,b)/sqrt(list_dot_product(a,a))/sqrt(list_dot_product(b,b)),6) AS cosine, round(sqrt(list_dot_product(a,a))/sqrt(list_dot_product(b,b)),6) AS ratio FROM x")
def sk7_vector_geometry(spark, sf):
    a = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", *[r6(c, k) for k, c in K.vector_geometry(a, F.transform(a, lambda x: F.abs(x))).items()])


@R.add("SELECT doc_id, (row_number() OVER (ORDER BY doc_id)-1)::BIGINT AS row_pos FROM documents QUALIFY row_pos BETWEEN 5 AND 49")
def sc1_records(spark, sf):
    return D.read_records(spark, f"{sf}/documents.parquet@[5:50]").select("doc_id", "row_pos")
