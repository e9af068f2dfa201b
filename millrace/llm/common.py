"""What the operators of this folder share: table access, written intermediate tables, stable rows, joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session (tests) may leave it unset and gets a
    temporary one; on a cluster that would be a folder of one machine, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """The folder of this application's written tables."""
    return f"{shared_folder(spark)}/millrace/{spark.sparkContext.applicationId}"


#: Rows of a narrow table that one task and one file may well hold.
ROWS_A_TASK = 50_000


def written(df: DataFrame, label: str, at_most: int | None = None) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read back.

    This cuts the lineage: a later loss of executors re-reads files instead of repeating work, and
    values such as partition numbers stay what they were. `release` deletes one table, `clear` all of them. The result has
    the number of its rows in `rows` (tasks that ran twice may count twice, so take it for a size). Where it is known that a
    narrow table has `at_most` so many rows, small ones take fewer tasks and files than there are shuffle partitions."""
    spark, seen = df.sparkSession, Observation()
    if at_most is not None:
        df = df.coalesce(buckets(at_most, ROWS_A_TASK))
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.observe(seen, F.count("*").alias("rows")).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to, out.rows = path, seen.get["rows"]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.written_to)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written; results that weren't saved before can't be read afterwards."""
    _delete(spark, scratch(spark))


def packed(df: DataFrame) -> Column:
    """All columns of `df` in one struct, so that working columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`").cast("string").alias(c) if t == "void" else F.col(f"`{c}`") for c, t in df.dtypes])


def buckets(rows: int, each: int) -> int:
    """How many buckets hold `rows` rows at about `each` rows."""
    return max(1, -(-rows // each))


#: Working column that tells rows apart: the file (a hash of its path) and the row within it.
ROW = "__row"
ROW_TYPE = "struct<file:bigint,at:bigint>"


def numbered(df: DataFrame) -> DataFrame:
    """`df` with the identity of each row, the same in every job however the scan is split.

    A plain scan of Parquet files, filtered at most, has it in its metadata; anything else is written first, since a
    task that is run again may see its rows in another order."""
    plan = df._jdf.queryExecution().analyzed().toString()
    plain = all(line.lstrip(" +-:").startswith(("Relation ", "Filter ", "SubqueryAlias ")) for line in plan.strip().splitlines())
    if plain and df._jdf.queryExecution().analyzed().deterministic():
        try:
            return _identified(df)
        except AnalysisException:  # files of another format have no row numbers
            pass
    return _identified(written(df, "rows"))


def _identified(df: DataFrame) -> DataFrame:
    meta = df.metadataColumn("_metadata")
    return df.withColumn(ROW, F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at")))


def joined_to_counted(rows: DataFrame, names: DataFrame, keys: list[str], total: int, share: int = 1000) -> DataFrame:
    """The inner join of `rows` with `names`, which has one row for each key and how many `rows` it meets (`times`).

    Keys that meet over a `share`th of the `total` rows, of which there are fewer than `share`, are broadcast, so no task
    gets all rows of one; the others are shuffled at every size, since both sides grow with the data. Both are read twice, so
    they should be written tables."""
    often = F.col("times") > F.lit(total / share)
    hot = F.broadcast(names.filter(often))
    rest = rows.join(F.broadcast(names.filter(often).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(names.filter(~often).hint("merge"), keys))
