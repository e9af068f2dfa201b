"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

A uniform random permutation of N rows, cut into shards, sends from input partition p to shard s a
number of rows that follows the multivariate hypergeometric law. Drawing that matrix first makes every
shard size exact; permuting within each partition, exchanging by the matrix and permuting within each
shard then gives a uniform permutation without a global sort.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import buckets, packed, written


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows: partitions, columns: shards. Row sums are `counts`; column sums differ by one at most."""
    total = int(sum(counts))
    rng = np.random.default_rng(seed)
    room = np.full(n_shards, total // n_shards, dtype=np.int64)
    room[: total % n_shards] += 1
    out = np.zeros((len(counts), n_shards), dtype=np.int64)
    for p, n in enumerate(counts):
        out[p] = rng.multivariate_hypergeometric(room, n, method="marginals")
        room -= out[p]
    return out


def shuffle_into_shards(rows: DataFrame, n_shards: int = 16, seed: int = 20, bucket_rows: int = 4096) -> DataFrame:
    """All columns of `rows`, with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard).

    Counts of any two shards differ by one at most. Rows are told apart by where they were read, so
    nulls, ties and repeated rows are shuffled like any other; a hot key has no effect. An empty table
    gives an empty result. Columns named shard or slot are replaced. Only one number for each input
    partition reaches the driver. `bucket_rows` bounds what one task sorts within a shard.
    """
    spark = rows.sparkSession
    kept = rows.drop("shard", "slot")
    placed = written(
        kept.select(packed(kept).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rid")),
        "shuffle-in",
    )
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    total = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], n_shards, seed).cumsum(axis=1)
    sent = spark.createDataFrame(
        [(p, [int(x) for x in m]) for (p, _), m in zip(counts, matrix, strict=True)], "part int, upto array<bigint>"
    )
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "rid"), "rid")
    dealt = (
        placed.withColumn("at", F.row_number().over(local))
        .join(sent, "part")
        .select(
            "row",
            "rid",
            F.size(F.filter("upto", lambda x: x < F.col("at"))).alias("shard"),
            F.pmod(F.xxhash64(F.lit(seed + 1), "rid"), F.lit(buckets(total // n_shards, bucket_rows))).alias("bucket"),
        )
    )
    dealt = written(dealt, "shuffle-dealt")
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy(F.xxhash64(F.lit(seed + 2), "rid"), "rid")
    return (
        dealt.withColumn("n", F.row_number().over(within))
        .join(starts, ["shard", "bucket"])
        .select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("n") - 1).alias("slot"))
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Each shard in a folder of its own, in files that hold ranges of slots in order."""
    parts = sharded.sparkSession.conf.get("spark.sql.shuffle.partitions")
    (
        sharded.repartitionByRange(int(parts), "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )


def sharded_documents(docs: DataFrame) -> DataFrame:
    """The rows law over `documents`: sizes and checksums of whole texts, and where each row goes."""
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shuffle_into_shards(slim, 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
