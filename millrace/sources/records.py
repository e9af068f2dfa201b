"""Reading and writing of record files: JSONL and Parquet with row positions, guarded sinks, drawn schemas."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType
from pyspark.sql.window import Window

from ..operators.lineage import cut
from ..operators.selection import sliced

SLICE = re.compile(r"^(.*)@\[(-?\d*):(-?\d*)\]$")


def read_records(spark: SparkSession, path: str, schema: str | None = None, strict: bool = False) -> DataFrame:
    """`file.jsonl` or `file.parquet`, with an optional `@[a:b]`, and `row_pos` in file order.

    Blank lines and, unless `strict`, broken ones are skipped. Another suffix is an error."""
    m = SLICE.match(path)
    file, start, stop = (m[1], *[int(x) if x else None for x in (m[2], m[3])]) if m else (path, None, None)
    if file.endswith(".parquet"):
        df = spark.read.parquet(file)
    elif file.endswith((".jsonl", ".json")):
        reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
        df = (reader.schema(schema) if schema else reader).json(file)
    else:
        raise ValueError(f"neither JSONL nor Parquet: {file}")
    df = positioned(df)
    return sliced(df, "row_pos", start, stop) if m else df


def positioned(df: DataFrame) -> DataFrame:
    """`row_pos` from 0 in reading order, the same in every job however the scan is split.

    Rows of Parquet files know their place in the file, which is shifted by the counts of the files before it (by path); other
    rows are numbered once, in files of their own."""
    try:
        meta = df.metadataColumn("_metadata")
        rows = df.withColumn("__file", meta["file_path"]).withColumn("__at", meta["row_index"])
        rows.schema
    except AnalysisException:  # no files, or files of a format without row numbers
        rows = cut(df.withColumn("__id", F.monotonically_increasing_id()))
        rows = rows.withColumn("__file", F.shiftrightunsigned("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")
    counts = rows.groupBy("__file").count()  # one row for each file or part
    before = F.coalesce(F.sum("count").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(counts.select("__file", before.alias("__before")), "__file").withColumn("row_pos", F.col("__before") + F.col("__at")).drop("__file", "__at", "__before")


def json_safe(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def json_safe_deep(value: Column, kind: DataType) -> Column:
    """`value` of the type `kind` with null for NaN and infinities at any depth of structs, arrays and values of maps; keys of maps are texts."""
    if isinstance(kind, (DoubleType, FloatType)):
        return json_safe(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: json_safe_deep(x, kind.elementType))
    if isinstance(kind, MapType):
        keyed = F.transform_keys(value, lambda k, _: k.cast("string"))
        return F.transform_values(keyed, lambda _, v: json_safe_deep(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[json_safe_deep(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def json_safe_rows(df: DataFrame) -> DataFrame:
    """All columns of `df` by `json_safe_deep`."""
    return df.select(*[json_safe_deep(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def compact_metadata(metadata: Column, heavy: list[str], most: int = 8192) -> tuple[Column, Column]:
    """A map without heavy keys and values of over `most` characters, and the hash of the whole."""
    kept = F.map_filter(metadata, lambda k, v: ~k.isin(heavy) & (F.length(v) <= most))
    return kept, F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(metadata)))), 256)


def write_new(df: DataFrame, path: str, *by: str) -> None:
    """Refuses to overwrite."""
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)


def write_csv_union(frames: list[DataFrame], path: str) -> None:
    """All columns of all frames, sorted by name, with a header."""
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    df.select(sorted(df.columns)).write.mode("errorifexists").option("header", True).csv(path)
