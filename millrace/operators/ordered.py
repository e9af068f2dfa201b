"""Ordered and interval operators: curves, stability, forgetting, merged intervals, span pairing, span depth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .lineage import cut


def curve_area(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Trapezoid area under each curve and the same over its span; null below two points."""
    w = Window.partitionBy(*keys).orderBy(x)
    step = df.withColumn("__dx", F.col(x) - F.lag(x).over(w)).withColumn("__my", (F.col(y) + F.lag(y).over(w)) / 2)
    g = step.groupBy(*keys).agg(F.sum(F.col("__dx") * F.col("__my")).alias("auc"), F.sum("__dx").alias("__span"))
    return g.withColumn("normalized_auc", F.try_divide("auc", "__span")).drop("__span")


def three_in_a_row(df: DataFrame, keys: list[str], order: str, value: str, limit: float) -> DataFrame:
    """Whether three consecutive values exceed the limit."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, 2)
    bad = (F.min(value).over(w) > limit) & (F.count(value).over(w) == 3)
    return df.withColumn("__bad", bad).groupBy(*keys).agg(F.coalesce(F.bool_or("__bad"), F.lit(False)).alias("unstable"))


def run_faults(train: DataFrame, evals: DataFrame, runs: DataFrame, run: str, limit: float) -> DataFrame:
    """(run, faults, stable) of each of `runs` (run, updates: how many it should have, null if it isn't complete).

    `train` has (run, step, norm, clipped), `evals` (run, step, score). Faults, in order: incomplete; score_not_finite; final_missing, if no finite
    score stands at the last update; norm_not_finite, of which a missing norm is one; three_norms, if three finite norms in a
    row exceed the limit; clipped, if over half of the steps that tell it were clipped."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    scores = evals.join(runs, run).filter(F.col("score").isNotNull()).groupBy(run).agg(F.bool_or(~finite("score")).alias("odd"), F.bool_or(finite("score") & (F.col("step") == F.col("updates"))).alias("final"))
    high = three_in_a_row(train.filter(finite("norm")), [run], "step", "norm", limit).withColumnRenamed("unstable", "high")
    steps = train.groupBy(run).agg(F.bool_or(~finite("norm")).alias("broken"), F.avg(F.col("clipped").cast("double")).alias("share"))
    all_of = runs.join(scores, run, "left").join(steps, run, "left").join(high, run, "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    rules = {"incomplete": F.col("updates").isNull(), "score_not_finite": no(F.col("odd")), "final_missing": ~no(F.col("final")), "norm_not_finite": no(F.col("broken")), "three_norms": no(F.col("high")), "clipped": no(F.col("share") > 0.5)}
    faults = F.filter(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules.items()]), lambda x: x.isNotNull())
    return all_of.select(run, faults.alias("faults"), (F.size(faults) == 0).alias("stable"))


def forgetting(df: DataFrame, task: str, order: str, score: str) -> DataFrame:
    """First score, best so far, how far below the best, and how far above the first."""
    w = Window.partitionBy(task).orderBy(order)
    best = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(score).over(w)
    return df.select("*", first.alias("first"), best.alias("best"), (best - F.col(score)).alias("forgetting"), (F.col(score) - first).alias("backward_transfer"))


def transitions(df: DataFrame, key: list[str], order: str, passed: str) -> DataFrame:
    before = F.lag(passed).over(Window.partitionBy(*key).orderBy(order))
    d = df.withColumn("__before", before).filter("__before is not null")
    p, b = F.col(passed), F.col("__before")
    return d.agg(F.count("*").alias("matched"), F.count_if(b & ~p).alias("pass_to_fail"), F.count_if(~b & p).alias("fail_to_pass"))


def merged_intervals(df: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Touching or overlapping intervals as one: keys, island, start, stop."""
    w = Window.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("__reach", reach).withColumn("island", F.sum(F.when(F.col(start) <= F.col("__reach"), 0).otherwise(1)).over(w))
    return d.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(stop).alias("stop"))


def idle_gaps(islands: DataFrame, keys: list[str]) -> DataFrame:
    before = F.lag("stop").over(Window.partitionBy(*keys).orderBy("start"))
    return islands.withColumn("from", before).filter(F.col("from").isNotNull()).select(*keys, "from", F.col("start").alias("to"), (F.col("start") - F.col("from")).alias("gap"))


def batches(df: DataFrame, keys: list[str], order: list[str], size: int, value: str) -> DataFrame:
    """Every `size` consecutive rows as one; an incomplete rest is dropped."""
    n = (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size
    g = df.withColumn("batch", F.floor(n)).groupBy(*keys, "batch").agg(F.count("*").alias("__n"), F.sum(value).alias("total"))
    return g.filter(F.col("__n") == size).drop("__n")


def newest_groups(df: DataFrame, group: str, time: str | Column, n: int, *nested: Column) -> DataFrame:
    """The rows of the `n` groups with the latest row, the smaller group of equal ones. A row without a `time` of its own takes the first
    of the `nested` ones that isn't null; one without any counts as the earliest."""
    at = F.coalesce(F.col(time) if isinstance(time, str) else time, *nested)
    top = df.groupBy(group).agg(F.max(at).alias("__t")).orderBy(F.desc_nulls_last("__t"), group).limit(n)
    return df.join(top.select(group), group, "left_semi")


def paired_effects(df: DataFrame, arm: str, base: str, pair: list[str], by: list[str], value: str, order: str) -> DataFrame:
    """(arm, by, pairs, effect): the mean difference of each arm from the arm `base`, over what both have under equal `by` and `pair`. Of rows with
    the same arm, `by` and `pair` the last by `order` counts; what only one arm has makes no pair, and null values none either."""
    keys = [*by, *pair]
    last = df.groupBy(arm, *keys).agg(F.max_by(value, order).alias("v")).filter(F.col("v").isNotNull())
    other = last.filter(F.col(arm) == base).select(*keys, F.col("v").alias("base"))
    both = last.filter(F.col(arm) != base).join(other, keys)
    return both.groupBy(arm, *by).agg(F.count("*").alias("pairs"), F.avg(F.col("v") - F.col("base")).alias("effect"))


def runs_of_ones(df: DataFrame, key: str, mask: Column) -> DataFrame:
    """Maximal runs of 1 in a mask: key, start (from 0), length."""
    d = df.select(key, F.posexplode(mask).alias("i", "m")).filter("m = 1")
    d = d.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(key).orderBy("i")))
    return d.groupBy(key, "run").agg(F.min("i").alias("start"), F.count("*").alias("length")).drop("run")


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; minima are made before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def span_depths(spans: DataFrame) -> DataFrame:
    """Depth by parent pointers: 0 for roots, missing parents and what leads into a cycle. Pointers are doubled, so depths of
    n take log n joins; a pointer that is left when it has jumped more often than there are spans runs in a cycle."""
    at = cut(spans.select("span", "parent").join(spans.select(F.col("span").alias("parent")), "parent", "left_semi").select("span", "parent", F.lit(1).cast("bigint").alias("hops")))
    for _ in range(at.count().bit_length() + 1):
        if at.filter("parent is not null").isEmpty():
            break
        up = at.select(F.col("span").alias("parent"), F.col("parent").alias("above"), F.col("hops").alias("more"))
        at = cut(at.join(up, "parent", "left").select("span", F.col("above").alias("parent"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
    ended = at.filter("parent is null").drop("parent")
    return spans.select("span").join(ended, "span", "left").select("span", F.coalesce("hops", F.lit(0)).alias("depth"))


#: Levels of the tree of buckets: 2^40 of them.
LEVELS = 40


def covering_nodes(first: Column, last: Column) -> Column:
    """The fewest nodes (level, at) of a binary tree over buckets that cover the buckets from `first` to `last` exactly: two a level at most."""

    def nodes(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k)
        low, high = F.ceil(first / size), F.floor((last + 1) / size)
        left = F.when((low < high) & (low % 2 != 0), F.struct(k.alias("level"), low.cast("bigint").alias("at")))
        right = F.when((low < high) & (high % 2 != 0), F.struct(k.alias("level"), (high - 1).cast("bigint").alias("at")))
        return F.array(left, F.when(right["at"] == left["at"], F.lit(None)).otherwise(right))

    size = last - first + 1
    highest = F.when(size >= 1, F.least(F.lit(LEVELS), F.floor(F.log2(size)).cast("int") + 1))  # no node is larger than what it covers
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), highest), nodes)), lambda n: n.isNotNull())


#: Rows that a range of times is made for, and how many ranges there are at most: the driver holds a number for each pair of them.
RANGE_ROWS, MOST_RANGES = 1 << 17, 512


def time_bounds(gaps: DataFrame, ops: DataFrame) -> np.ndarray:
    """Where ranges of times begin, by what is found in all ends of intervals. A time that many share is a range by itself."""
    ends = gaps.select(F.explode(F.array("from", "to")).alias("t")).unionAll(ops.select(F.explode(F.array("start", "stop")).alias("t")))
    shares = [i / MOST_RANGES for i in range(1, MOST_RANGES)]
    n, found = ends.filter(F.abs("t") < float("inf")).agg(F.count("*"), F.percentile_approx("t", shares, 10 * MOST_RANGES)).first()
    tasks = int(gaps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MOST_RANGES, max(n // 2 // RANGE_ROWS, min(tasks, n // 2 // 4096)) + 1)
    starts, times = np.unique([found[i * MOST_RANGES // ranges - 1] for i in range(1, ranges)], return_counts=True) if n else (np.empty(0), np.empty(0, int))
    return np.unique(np.concatenate([starts, np.nextafter(starts[times > 1], np.inf)]))


def first_hits(start: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each (low, high) the first place with start < high and stop > low, or how many places there are.

    The places that start before `high` are a prefix by start, so a few blocks of 1, 2, 4, ... of them; in each, sorted by stop, those beyond
    `low` are a prefix again, of which the least place is known."""
    n, out = len(start), np.full(len(low), len(start))
    by_start, rank = np.argsort(start, kind="stable"), np.empty(n, np.int64)
    rank[np.argsort(-stop, kind="stable")] = np.arange(n)
    until, beyond = np.searchsorted(start[by_start], high, "left"), n - np.searchsorted(np.sort(stop), low, "right")
    levels = max(n - 1, 0).bit_length() + 1
    keys = np.full(1 << (levels - 1), n << 32 | n)
    keys[:n] = rank[by_start] << 32 | by_start
    for k in range(levels):
        keys = np.sort(keys.reshape(-1, 1 << k), axis=1, kind="stable")
        own = np.flatnonzero(until >> k & 1)
        if len(own):
            block = until[own] >> (k + 1) << 1
            ranks = ((keys >> 32) + np.arange(len(keys))[:, None] * (n + 1)).ravel()
            held = np.searchsorted(ranks, block * (n + 1) + beyond[own], "left") - (block << k)
            least, some = np.minimum.accumulate(keys & 0xFFFFFFFF, axis=1), held > 0
            out[own[some]] = np.minimum(out[own[some]], least[block[some], held[some] - 1])
    return out


def overlapping(gaps: DataFrame, ops: DataFrame, width: float) -> DataFrame:
    """Each gap (gap_id, from, to) with the first op (pos, name, start, stop) that overlaps it; `width` isn't needed.

    No pair is made. Times are dealt into ranges, and an op can meet a gap (start < to, stop > from) in three ways only. It starts in the range
    in which the gap ends, or stops in that in which the gap begins: either side goes to the two ranges of its ends, and a task finds the
    first op of each gap there. Or its start lies in a lower range than `to` and its stop in a higher one than `from`: for that the
    first op of each pair of ranges is enough, which the driver holds. In a range of one time no end lies below another."""
    gaps = gaps.select("gap_id", F.col("from").cast("double").alias("from"), F.col("to").cast("double").alias("to")).dropna(subset=["from", "to"])
    ops = ops.select("pos", "name", F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop")).dropna(subset=["start", "stop"])
    bounds = time_bounds(gaps, ops)
    ranges = len(bounds) + 1
    point = np.concatenate([[False], bounds[1:] == np.nextafter(bounds[:-1], np.inf), [False]]) if ranges > 1 else np.array([False])
    first_op, gap_id = ([T.StructField(f.name, f.dataType) for f in x.schema] for x in (ops.select("pos", "name"), gaps.select("gap_id")))  # either may be null in a row
    by_pos = [("pos", "ascending")]

    def ends(batch, x: str, y: str) -> tuple[np.ndarray, ...]:
        x, y = (batch[c].to_numpy(zero_copy_only=False) for c in (x, y))
        return x, y, np.searchsorted(bounds, x, "right"), np.searchsorted(bounds, y, "right")

    def firsts(found: pa.Table) -> pa.Table:
        found = found.take(pc.sort_indices(found, by_pos, null_placement="at_end"))
        return found.take(pa.array(np.unique(found["cell"].to_numpy(), return_index=True)[1]))

    def of_pairs(batches):
        held = []
        for batch in batches:
            _, _, p, q = ends(batch, "start", "stop")
            held.append(firsts(pa.table({"cell": p * ranges + q, "pos": batch["pos"], "name": batch["name"]})))
            if sum(map(len, held)) > 1 << 18 and len(held) > 1:
                held = [firsts(pa.concat_tables(held))]
        if held:
            yield from firsts(pa.concat_tables(held)).to_batches()

    first = F.min_by(F.struct("pos", "name"), F.struct(F.col("pos").isNull(), "pos")).alias("f")
    pairs = ops.mapInArrow(of_pairs, T.StructType([T.StructField("cell", T.LongType()), *first_op])).groupBy("cell").agg(first).select("cell", "f.*").toArrow()  # one row for each pair of ranges
    pairs = pairs.take(pc.sort_indices(pairs, by_pos, null_placement="at_end"))
    least = np.full((ranges + 1, ranges + 1), len(pairs), np.int32)
    least[1 + pairs["cell"].to_numpy() // ranges, pairs["cell"].to_numpy() % ranges] = np.arange(len(pairs))
    # [p, q]: the first of all that start in ranges before p and stop in ranges after q.
    least = np.minimum.accumulate(np.minimum.accumulate(least, axis=0)[:, ::-1], axis=1)[:, ::-1][:-1, 1:]
    used, place = np.unique(least, return_inverse=True)
    known, place = pairs.select(["pos", "name"]).take(pa.array(used[used < len(pairs)])), place.reshape(least.shape).astype(np.int32)

    # An op is of kind 0, a gap of kind 1, or 2 with the first op that its pair of ranges knows.
    shape = T.StructType([T.StructField("range", T.LongType()), T.StructField("kind", T.ByteType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), *first_op, *gap_id])
    names = to_arrow_schema(shape)

    def rows(columns: list) -> pa.RecordBatch:
        flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(flat, names, strict=True)], schema=names)

    def dealt_ops(batches):
        for batch in batches:
            x, y, p, q = ends(batch, "start", "stop")
            one, two = np.flatnonzero(~point[p]), np.flatnonzero(~point[q] & (p != q))
            at = np.concatenate([one, two])
            yield rows([np.concatenate([p[one], q[two]]), np.zeros(len(at)), x[at], y[at], batch["pos"].take(pa.array(at)), batch["name"].take(pa.array(at)), pa.nulls(len(at), names.field("gap_id").type)])

    def dealt_gaps(batches):
        for batch in batches:
            x, y, p, q = ends(batch, "to", "from")
            best = place[p, q]
            some = best < len(known)
            one, two = np.flatnonzero(~point[p] | some), np.flatnonzero(~point[q] & (p != q))
            at = np.concatenate([one, two])
            to = np.concatenate([np.where(point[p], -1 - np.arange(len(p)) % 1024, p)[one], q[two]])  # below 0 no op waits
            kinds = np.concatenate([np.where(some[one], 2, 1), np.ones(len(two))])
            best = pa.array(np.concatenate([best[one], np.zeros(len(two), np.int32)]), mask=kinds == 1)
            yield rows([to, kinds, x[at], y[at], known["pos"].take(best), known["name"].take(best), batch["gap_id"].take(pa.array(at))])

    def met(table: pa.Table) -> pa.Table:
        gap = pc.greater(table["kind"], 0)
        ops, gaps = table.filter(pc.invert(gap)), table.filter(gap)
        ops = ops.take(pc.sort_indices(ops, by_pos, null_placement="at_end"))
        hit = first_hits(ops["x"].to_numpy(), ops["y"].to_numpy(), gaps["y"].to_numpy(), gaps["x"].to_numpy())
        own = np.flatnonzero(hit < len(ops))
        here = pa.table([gaps["gap_id"].take(pa.array(own)), *(ops[c].take(pa.array(hit[own])) for c in ("pos", "name"))], names=["gap_id", "pos", "name"])
        return pa.concat_tables([gaps.filter(pc.equal(gaps["kind"], 2)).select(["gap_id", "pos", "name"]), here])

    dealt = gaps.mapInArrow(dealt_gaps, shape).unionAll(ops.mapInArrow(dealt_ops, shape))
    return dealt.groupBy("range").applyInArrow(met, T.StructType([*gap_id, *first_op])).groupBy("gap_id").agg(F.min_by("name", "pos").alias("name"))


def longest_gaps(gaps: DataFrame, ops: DataFrame, width: float, most: int = 15) -> DataFrame:
    """The `most` longest gaps (gap_id, from, to), each with its length and the first op that overlaps it, if one does; of equal ones
    the smaller gap_id. They are few, so every op is held against them where it lies; `width` isn't needed for that."""
    top = gaps.withColumn("gap", F.col("to") - F.col("from")).orderBy(F.desc("gap"), "gap_id").limit(most)
    hit = ops.join(F.broadcast(top.select("gap_id", "from", "to")), (F.col("start") < F.col("to")) & (F.col("stop") > F.col("from")))  # `most` rows
    first = hit.groupBy("gap_id").agg(F.min_by("name", "pos").alias("name"))
    return top.join(first, "gap_id", "left").select("gap_id", "gap", "name")
