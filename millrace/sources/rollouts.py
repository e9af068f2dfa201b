"""Rollout data at rest: cursors over epochs, buffers, manifests, dumps, artifacts and metric events. State lives in
tables that a job writes, never on the driver alone."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import epoch_order
from .records import compact_metadata, write_new


def cursor_scan(df: DataFrame, position: str, offset: int, count: int, seed: int, total: int) -> DataFrame:
    """`count` rows from `offset` on, over epochs that are each in their own order: `epoch`, `epoch_pos`. A scan may run
    into the next epoch, not further."""
    if count > total:
        raise ValueError("a scan may not wrap twice")
    epoch, start = divmod(offset, total)
    tail = epoch_order(df, position, seed, epoch).filter(F.col("epoch_pos").between(start, start + count - 1)).withColumn("epoch", F.lit(epoch))
    if start + count <= total:
        return tail
    head = epoch_order(df, position, seed, epoch + 1).filter(F.col("epoch_pos") < start + count - total).withColumn("epoch", F.lit(epoch + 1))
    return tail.unionByName(head)


def save_cursor(spark: SparkSession, path: str, rollout_id: int, offset: int, group_index: int, index: int) -> None:
    """One row for each rollout; saving again replaces it."""
    row = spark.range(1).select(F.lit(offset).cast("bigint").alias("offset"), F.lit(group_index).cast("bigint").alias("group_index"), F.lit(index).cast("bigint").alias("index"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/rollout_id={rollout_id}")


def restored_cursor(spark: SparkSession, path: str, rollout_id: int) -> dict[str, int]:
    return spark.read.parquet(f"{path}/rollout_id={rollout_id}").first().asDict()


def save_sampler(spark: SparkSession, path: str, config: dict, state: dict[str, int]) -> None:
    """The state of a sampler (a number for each source) beside the configuration that it belongs to; saving again replaces it."""
    text = json.dumps(config, sort_keys=True)
    rows = [(text, k, int(v)) for k, v in sorted(state.items())]
    spark.createDataFrame(rows, "config string, source string, at bigint").coalesce(1).write.mode("overwrite").parquet(path)


def restored_sampler(spark: SparkSession, path: str, config: dict) -> dict[str, int]:
    """The saved state; an error if it belongs to another configuration."""
    rows = spark.read.parquet(path).collect()  # one for each source
    if {r["config"] for r in rows} != {json.dumps(config, sort_keys=True)}:
        raise ValueError("the state belongs to another configuration")
    return {r["source"]: r["at"] for r in rows}


def buffer_first(buffer: DataFrame, source: DataFrame, arrival: str, count: int) -> DataFrame:
    """`count` rows: the buffer by arrival, then the source by its own order; `from_buffer` says which."""
    both = buffer.withColumn("from_buffer", F.lit(True)).unionByName(source.withColumn("from_buffer", F.lit(False)), allowMissingColumns=True)
    return both.orderBy(F.desc("from_buffer"), arrival).limit(count)


def checked_groups(df: DataFrame, group: str, size: int) -> DataFrame:
    """`df` itself; an error if a group hasn't `size` rows."""
    wrong = df.groupBy(group).count().filter(F.col("count") != size).select(group)
    odd = wrong.select(F.col(group).alias("__odd"))
    return df.join(odd, F.col(group).eqNullSafe(F.col("__odd")), "left").filter(
        F.when(F.col("__odd").isNotNull(), F.raise_error(F.lit(f"a group hasn't {size} rows")).cast("boolean")).otherwise(F.lit(True))
    ).drop("__odd")


def manifest(spark: SparkSession, text: str, base: str) -> DataFrame:
    """(name, path, weight) of a JSON manifest: names are unique, paths are relative to `base` unless absolute."""
    sources = json.loads(text)["sources"]
    names = [s["name"] for s in sources]
    if not names or len(set(names)) != len(names):
        raise ValueError("a manifest needs sources with unique names")
    place = lambda p: p if p.startswith("/") or "://" in p else f"{base.rstrip('/')}/{p}"
    return spark.createDataFrame([(s["name"], place(s["path"]), float(s.get("weight", 1.0))) for s in sources], "name string, path string, weight double")


def dump_rollout(df: DataFrame, path: str, step: int, evaluation: bool = False) -> None:
    df.write.mode("errorifexists").parquet(f"{path}/evaluation={str(evaluation).lower()}/step={step}")


def replay_rollout(spark: SparkSession, path: str, step: int, evaluation: bool = False) -> DataFrame:
    """What `dump_rollout` wrote for the step; only its folder is listed and read."""
    return spark.read.parquet(f"{path}/evaluation={str(evaluation).lower()}/step={step}")


def content_digest(df: DataFrame) -> str:
    """Of the rows in any order, repeats counted: sums of two hashes of each, which tasks add up."""
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("j"))
    h = [F.sum(F.xxhash64(F.lit(s), "j").cast("decimal(38,0)")).cast("string") for s in (1, 2)]
    return rows.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *h), 256).alias("d")).first()["d"]


def publish_once(df: DataFrame, path: str) -> bool:
    """Writes where nothing is; the same rows again are no change, others an error. Whether it wrote."""
    from pyspark.errors import AnalysisException

    try:
        there = df.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        write_new(df, path)
        return True
    if content_digest(there) != content_digest(df):
        raise ValueError(f"other rows are published in {path}")
    return False


# Metadata that an evaluation artifact leaves out.
HEAVY = ["unit_tests", "private_test_cases", "public_test_cases", "sandboxfusion_row", "test"]


def save_evaluation(df: DataFrame, path: str, rollout_id: int, dataset: str = "dataset", metadata: str = "metadata") -> DataFrame:
    """JSON lines for each dataset, heavy metadata replaced by its hash; refuses to overwrite. The index of what was
    written (dataset, rows, sha256 over the rows' hashes), also saved beside it."""
    kept, digest = compact_metadata(F.col(metadata), HEAVY)
    rows = df.withColumn("metadata_sha256", digest).withColumn(metadata, kept)
    place = f"{path}/rollout_{rollout_id}"
    rows.write.mode("errorifexists").partitionBy(dataset).json(place)
    line = F.xxhash64(F.to_json(F.struct(*[c for c in rows.columns if c != dataset])))
    index = rows.groupBy(dataset).agg(F.count("*").alias("rows"), F.sha2(F.sum(line.cast("decimal(38,0)")).cast("string"), 256).alias("digest"))
    index.withColumn("rollout_id", F.lit(rollout_id)).coalesce(1).write.mode("errorifexists").json(f"{path}/index_{rollout_id}")
    return index


def append_metrics(spark: SparkSession, path: str, step_key: str, metrics: dict[str, float]) -> None:
    """One event for each namespace (what comes before the first slash), appended to its folder."""
    step = int(metrics[step_key])
    rows = [(k.split("/")[0], step, k, float(v)) for k, v in metrics.items() if k != step_key]
    spark.createDataFrame(rows, "namespace string, step bigint, metric string, value double").coalesce(1).write.mode("append").partitionBy("namespace").json(path)


def trace_events(spark: SparkSession, path: str) -> DataFrame:
    """One row for each event of profiler traces, gzip or plain."""
    whole = spark.read.schema("traceEvents array<struct<name string, cat string, ph string, ts double, dur double, pid string, tid string>>")
    return whole.option("multiLine", True).json(path).select(F.explode("traceEvents").alias("e")).select("e.*")


def fetch_by_position(corpus: DataFrame, wanted: DataFrame, position: str = "row_pos") -> DataFrame:
    """The rows of `corpus` at the positions in `wanted`, one for each request."""
    return wanted.join(corpus, position)


def supervised_feed(df: DataFrame, tokens: str, mask: str) -> DataFrame:
    """A finished conversation in place of a generation: the response begins at the first trained token, reward 0."""
    first = F.array_position(F.col(mask), F.lit(1).cast(df.schema[mask].dataType.elementType))
    n = F.when(first > 0, F.size(tokens) - first + 1).otherwise(0).cast("int")
    cut = F.when(n > 0, F.slice(mask, F.greatest(F.size(mask) - n + 1, F.lit(1)), n)).otherwise(F.slice(mask, 1, 0))
    return df.withColumn("response_length", n).withColumn("loss_mask", cut).withColumn("reward", F.lit(0.0))


def file_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, lines, first_line, bytes, digest) of every JSONL file; blank lines don't count. Files are listed, their
    lines hashed one by one, so no file has to fit in a task."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("at")).filter(F.trim("value") != "")
    return lines.groupBy("path").agg(
        F.count("*").alias("lines"), F.min_by("value", "at").alias("first_line"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string").alias("digest")
    )


def folder_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes and the hash over their sorted (name, size, time); contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    entry = F.concat_ws("\t", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("fingerprint"))


def expected_rows(df: DataFrame, path: str, count: int) -> None:
    """Writes `df` only if it has `count` rows."""
    found = df.count()
    if found != count:
        raise ValueError(f"{found} rows instead of {count}")
    write_new(df, path)


def boxed_label(solution: Column) -> Column:
    r"""What a \boxed{} around the whole text holds; anything else is an error."""
    t = F.trim(solution)
    return F.when(F.startswith(t, F.lit("\\boxed{")) & F.endswith(t, F.lit("}")), F.substring(t, F.lit(8), F.length(t) - 8)).otherwise(F.raise_error(F.concat(F.lit("no boxed answer: "), t)))
