"""Running sums, maxima and positions over a total order, without a task that holds all rows.

Rows are dealt out by value ranges, as many as the session has shuffle partitions, so they grow with what the session was set up
for. Each range is ordered by itself, and what lies before it comes from one row for each range. The ranges are written once,
since each plan may deal rows out in its own way. Rows of one value are told apart by the ties and by a hash of all that
they hold, so a column of one value is spread like any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut

PART, SALT = "__part", "__salt"


def in_ranges(df: DataFrame, order: str, ties: list[str] | None = None) -> DataFrame:
    """`df`, written, with the number of its range and the hash that tells equal rows apart."""
    whole = F.xxhash64(*[F.col(f"`{c}`").cast("string") if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes])
    salted = df.withColumn(SALT, whole)
    return cut(salted.repartitionByRange(order, *(ties or []), SALT).withColumn(PART, F.spark_partition_id()))


def running_sum(df: DataFrame, value: Column, name: str, order: str, ties: list[str] | None = None, within: list[str] | None = None, total: str | None = None) -> DataFrame:
    """`name`: the sum of `value` up to and with each row; `total`: that of its whole group."""
    return _running(df, value, name, order, ties or [], within or [], F.sum, lambda before, here: F.coalesce(before, F.lit(0)) + here, total)


def running_max(df: DataFrame, value: Column, name: str, order: str, ties: list[str] | None = None, within: list[str] | None = None) -> DataFrame:
    """`name`: the maximum of `value` up to and with each row; null while there is none."""
    return _running(df, value, name, order, ties or [], within or [], F.max, F.greatest)


def numbered_by(df: DataFrame, name: str, order: str, ties: list[str] | None = None, within: list[str] | None = None) -> DataFrame:
    """`name`: the position from 0 by `order`, nulls first, then by `ties`, in each group of `within`."""
    found = running_sum(df, F.lit(1).cast("bigint"), name, order, ties, within)
    return found.withColumn(name, F.col(name) - 1)


def _running(df, value, name, order, ties, within, merge, joined, total=None) -> DataFrame:
    """Ranges that `df` has already stay in the result, so that several running values can share them."""
    known = PART in df.columns
    rows = (df if known else in_ranges(df, order, ties)).withColumn("__value", value)
    salt = [SALT] if SALT in rows.columns else []
    totals = rows.groupBy(*within, PART).agg(merge("__value").alias("__total"))
    groups = Window.partitionBy(*within)
    earlier = groups.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *[F.col(w).alias(f"__{i}") for i, w in enumerate(within)], F.col(PART).alias("__range"), merge("__total").over(earlier).alias("__before"), *([merge("__total").over(groups).alias(total)] if total else [])
    )
    before = before if within else F.broadcast(before)  # one row for each range
    here = merge("__value").over(Window.partitionBy(*within, PART).orderBy(order, *ties, *salt).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col(PART) == F.col("__range")
    for i, w in enumerate(within):
        same = same & F.col(w).eqNullSafe(F.col(f"__{i}"))
    found = rows.withColumn("__here", here).join(before, same)
    own = [c for c in df.columns if c != name and (known or c not in (PART, SALT))]
    return found.select(*own, joined(F.col("__before"), F.col("__here")).alias(name), *([total] if total else []))


def exact_quantiles(df: DataFrame, keys: list[str], value: str | Column, qs: dict[str, float]) -> DataFrame:
    """(keys, a column for each of `qs`): exact quantiles, interpolated between neighbours; nulls don't count.

    Equal values are counted before anything is shuffled, so a value that is frequent is one row; the counts are summed up within
    value ranges, so no task holds a whole group, however many different values it has."""
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, v.cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    counts = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    upto = running_sum(counts, F.col("__n"), "__upto", "__v", within=keys, total="__size")
    at = lambda p: F.max(F.when((F.col("__upto") > p) & (F.col("__upto") - F.col("__n") <= p), F.col("__v")))
    out = []
    for name, q in qs.items():
        want = (F.col("__size") - 1) * F.lit(q)
        low, high = at(F.floor(want)), at(F.ceil(want))
        out.append((low + (high - low) * F.max(want - F.floor(want))).alias(name))
    return upto.groupBy(*keys).agg(*out)


def with_quantiles(df: DataFrame, keys: list[str], value: str | Column, qs: dict[str, float], *aggregates: Column) -> DataFrame:
    """(keys, `aggregates`, a column for each of `qs`), for each group; a group without a value has null quantiles."""
    plain = df.groupBy(*keys).agg(*aggregates)
    found = exact_quantiles(df, keys, value, qs)
    if not keys:
        return plain.join(F.broadcast(found))  # one row each
    found = found.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], *qs)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    return plain.join(found, same, "left").drop(*[f"__{i}" for i in range(len(keys))])
