"""What registered queries share: tables, and the roles that they play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored samples in groups: an order is a group, a returned line a pass."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_index"),
        F.col("l_linenumber").alias("index"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"),
        F.round(F.col("l_discount") * 10, 1).alias("score"),
        F.col("l_quantity").cast("int").alias("response_length"),
        F.col("l_linestatus").alias("source_name"),
        F.element_at(F.create_map(*map(F.lit, ["R", "truncated", "A", "aborted", "N", "completed"])), F.col("l_returnflag")).alias("status"),
        F.col("l_extendedprice").alias("price"),
    )


#: The same, for DuckDB.
SAMPLES = """samples AS (SELECT l_orderkey AS group_index, l_linenumber AS index, CASE WHEN l_returnflag='R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward,
 round(l_discount*10,1) AS score, l_quantity::INT AS response_length, l_linestatus AS source_name,
 CASE l_returnflag WHEN 'R' THEN 'truncated' WHEN 'A' THEN 'aborted' WHEN 'N' THEN 'completed' END AS status, l_extendedprice AS price FROM lineitem)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as token arrays: log-probabilities of three policies, a mask, and a reward."""
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        e.alias("x"),
        F.transform(e, lambda x: -F.abs(x)).alias("logp"),
        F.transform(e, lambda x, i: -F.abs(x) * 0.9 - 0.01 * (i % 5)).alias("old"),
        F.transform(e, lambda x, i: -F.abs(x) * 1.1 + 0.01 * (i % 3)).alias("base"),
        F.transform(e, lambda x, i: F.when(i % 3 == 0, 0.0).otherwise(1.0)).alias("mask"),
        F.transform(e, lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)).alias("adv"),
        F.col("label").cast("double").alias("reward"),
    )


TOKENS = """tok AS (SELECT vec_id, i, x, -abs(x) AS logp, -abs(x)*0.9-0.01*(i%5) AS old, -abs(x)*1.1+0.01*(i%3) AS base,
 CASE WHEN i%3=0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS mask, CASE WHEN i%2=0 THEN x ELSE -x END AS adv, reward
 FROM (SELECT vec_id, label::DOUBLE AS reward, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding,1)-1 AS i FROM embeddings))"""


def r6(c, name: str):
    """Rounded to six places; sums in another order differ in the last digits only."""
    return F.round(c, 6).alias(name)
