"""Mergeable sketches: hashed projections, logarithmic histograms and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS_AN_OCTAVE, LOWEST = 4, -149
BINS = (128 - LOWEST) * BINS_AN_OCTAVE
MASK32 = 0xFFFFFFFF


def times32(x: Column, constant: int) -> Column:
    """x * constant modulo 2^32, in halves that stay within 63 bits."""
    low, high = constant & 0xFFFF, constant >> 16
    return (x * F.lit(low) + F.shiftleft((x * F.lit(high)).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK32)


def mixed32(index: Column, seed: int) -> Column:
    """A 32-bit mixer: xor-shift and multiply, twice."""
    x = (index.cast("bigint") + F.lit(seed)).bitwiseAND(MASK32)
    x = times32(x.bitwiseXOR(F.shiftrightunsigned(x, 16)), 0x7FEB352D)
    x = times32(x.bitwiseXOR(F.shiftrightunsigned(x, 15)), 0x846CA68B)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def count_sketch(df: DataFrame, keys: list[str], index: str, value: str, dim: int, seed: int) -> DataFrame:
    """(keys, bucket, total): signed sums; sketches of shards add up."""
    h = mixed32(F.col(index), seed)
    sign = F.when(mixed32(F.col(index), seed + 1).bitwiseAND(1) == 1, 1.0).otherwise(-1.0)
    return df.groupBy(*keys, F.pmod(h, F.lit(dim)).cast("int").alias("bucket")).agg(F.sum(sign * F.col(value)).alias("total"))


def log_bin(value: Column) -> Column:
    """Bin of a magnitude; null for zero, an error for what isn't finite."""
    x = F.abs(value)
    finite = ~F.isnan(x) & (x != F.lit(float("inf")))
    at = F.floor((F.log2(x) - LOWEST) * BINS_AN_OCTAVE)
    return F.when(~finite, F.raise_error(F.lit("not finite")).cast("int")).when(x > 0, F.greatest(F.least(at, F.lit(BINS - 1)), F.lit(0)).cast("int"))


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, bin, n, energy); bin null holds the zeros."""
    return df.groupBy(*keys, log_bin(F.col(value)).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(value) * F.col(value)).alias("energy"))


def centre(bin_: Column) -> Column:
    return F.pow(F.lit(2.0), (bin_ + 0.5) / BINS_AN_OCTAVE + LOWEST)


def histogram_quantile(hist: DataFrame, keys: list[str], q: float, weight: str = "n") -> DataFrame:
    """Geometric centre of the bin in which the quantile falls; zeros come first. At most 1109 bins a key."""
    upto = F.sum(weight).over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("bin")))
    total = F.sum(weight).over(Window.partitionBy(*keys))
    h = hist.withColumn("__ok", upto >= q * total).withColumn("__bin", F.coalesce("bin", F.lit(-1)))
    at = h.filter("__ok").groupBy(*keys).agg(F.min("__bin").alias("b"))
    return at.select(*keys, F.when(F.col("b") < 0, 0.0).otherwise(centre(F.col("b"))).alias("quantile"))


def vector_geometry(a: Column, b: Column) -> dict[str, Column]:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return {"norm_a": na, "norm_b": nb, "cosine": F.try_divide(dot(a, b), F.nullif(na * nb, F.lit(0.0))), "ratio": F.try_divide(na, F.nullif(nb, F.lit(0.0)))}
