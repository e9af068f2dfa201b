"""Metrics of rollouts, training steps and runs: ratios of sums, summaries by column, merged parts, run analyses, and small decisions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions import tokens as T
from .groups import estimates, pass_rates
from .ranking import exact_quantiles, in_ranges, numbered_by, running_sum, with_quantiles

FINITE = float("inf")


def kept_vocabulary(offsets: Column, mask: Column, removed: Column) -> list[Column]:
    """Aggregates: kept candidates for each trained token, sums over sums; removed samples and those without offsets are left out."""
    width = F.zip_with(F.slice(offsets, F.lit(2), F.greatest(F.size(offsets) - 1, F.lit(0))), F.slice(offsets, F.lit(1), F.greatest(F.size(offsets) - 1, F.lit(0))), lambda b, a: (b - a).cast("double"))
    use = ~F.coalesce(removed, F.lit(False)) & (F.size(offsets) > 0)
    kept, count = F.sum(F.when(use, T.masked_sum(width, mask))), F.sum(F.when(use, T.total(mask)))
    return [F.try_divide(kept, count).alias("kept_per_token")]


def prefix_cache(cached: Column, prompt: Column) -> list[Column]:
    return [F.coalesce(F.try_divide(F.sum(cached), F.sum(prompt)), F.lit(0.0)).alias("hit_rate"), (F.sum(cached) / F.count("*")).alias("cached_per_sample")]


def statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median and extremes of each group."""
    v = F.col(value)
    return with_quantiles(df, keys, value, {"median": 0.5}, F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"))


def attribute_statistics(df: DataFrame, attributes: str, by: list[str] | None = None) -> DataFrame:
    """Mean, median, extremes and count of each key of a map over its finite values."""
    each = df.select(*(by or []), F.explode(attributes).alias("key", "value")).filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != FINITE))
    return statistics(each, [*(by or []), "key"], "value")


def column_means(df: DataFrame, leave_out: list[str], correct: Column | None = None) -> DataFrame:
    """(name, mean) of the numeric columns, and with `correct` their mean over the rows where it holds."""
    names = [c for c, t in df.dtypes if c not in leave_out and t in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    right = correct if correct is not None else F.lit(None).cast("boolean")
    entry = [F.struct(F.lit(c).alias("name"), F.avg(c).alias("mean"), F.avg(F.when(right, F.col(c))).alias("correct_mean")) for c in names]
    return df.agg(F.array(*entry).alias("all")).select(F.explode("all").alias("e")).select("e.*")


def turn_lengths(length: Column, mask_sum: Column, rounds: Column, most: int) -> list[Column]:
    """Lengths with and without what tools said, the share at the limit, and rounds."""
    out = [(F.avg((length >= most).cast("double"))).alias("clip_ratio")]
    for name, x in (("raw", length), ("own", mask_sum), ("rounds", rounds)):
        out += [F.avg(x).alias(f"{name}_mean"), F.max(x).alias(f"{name}_max"), F.min(x).alias(f"{name}_min")]
    return out


def contiguous_pass_rates(df: DataFrame, position: str, reward: str, size: int, ks: list[int]) -> DataFrame:
    """pass@k over groups of `size` neighbouring positions; a count that isn't a multiple of it is an error."""
    n = df.count()
    if n % size:
        raise ValueError(f"{n} rewards are no multiple of {size}")
    return pass_rates(df.withColumn("__group", F.floor(F.col(position) / size)), "__group", reward, ks)


def contribution(total: Column, count: Column) -> Column:
    return F.struct(total.cast("double").alias("total"), count.cast("double").alias("count"))


def merged_parts(df: DataFrame, by: list[str], metric: str, part: str, parts: str) -> DataFrame:
    """Final metrics from parts (total, count): sums over sums; a part without a count is a plain value, averaged over `parts`."""
    g = df.groupBy(*by, metric).agg(F.sum(f"{part}.total").alias("t"), F.sum(f"{part}.count").alias("c"), F.max(parts).alias("__parts"))
    return g.select(*by, metric, F.coalesce(F.try_divide("t", "c"), F.col("t") / F.col("__parts")).alias("value"))


def ordered_groups(df: DataFrame, key: str, position: str) -> DataFrame:
    """Groups by their first occurrence: key, first, rows."""
    return df.groupBy(key).agg(F.min(position).alias("first"), F.count("*").alias("rows"))


def merged_distributions(shards: DataFrame, by: list[str], n: str, mean: str, m2: str) -> DataFrame:
    """Count, mean and population deviation of a whole from those of its shards (n, mean, sum of squares about the mean)."""
    g = shards.groupBy(*by).agg(F.sum(n).alias("n"), (F.sum(F.col(n) * F.col(mean)) / F.sum(n)).alias("mean"), F.collect_list(F.struct(n, mean, m2)).alias("s"))
    spread = F.aggregate("s", F.lit(0.0), lambda acc, s: acc + s[m2] + s[n] * (s[mean] - F.col("mean")) * (s[mean] - F.col("mean")))
    return g.select(*by, "n", "mean", F.sqrt(spread / F.col("n")).alias("std"))


def metric_estimates(df: DataFrame, keys: list[str], metrics: list[str], seed: str) -> DataFrame:
    """Mean, deviation and interval of each metric that isn't null, and the seeds behind it."""
    long = df.select(*keys, seed, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("e")).select(*keys, seed, "e.*")
    long = long.filter(F.col("value").isNotNull())
    seeds = long.groupBy(*keys, "metric").agg(F.array_sort(F.collect_set(seed)).alias("seeds"))
    return estimates(long, [*keys, "metric"], "value").join(seeds, [*keys, "metric"])


def run_summary(df: DataFrame, run: str, step: str, metrics: list[str]) -> DataFrame:
    """Extremes, mean and sum of each metric of a run, and its value at the last step."""
    last = F.max_by(F.struct(*metrics), step).alias("__last")
    g = df.groupBy(run).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max), ("sum", F.sum))], last)
    return g.select(run, *[f"{m}_{n}" for m in metrics for n in ("min", "mean", "max", "sum")], *[F.col(f"__last.{m}").alias(f"{m}_last") for m in metrics])


def final_evaluation(df: DataFrame, run: str, phase: str, update: str) -> DataFrame:
    """The rows of the last update of each run: of those of phase `final`, if it has any."""
    ends = df.groupBy(run).agg(F.max(F.when(F.col(phase) == "final", F.col(update))).alias("__f"), F.max(update).alias("__a"))
    ends = ends.select(run, F.col("__f").isNotNull().alias("__only"), F.coalesce("__f", "__a").alias("__at"))
    return df.join(ends, run).filter((F.col(update) == F.col("__at")) & (~F.col("__only") | (F.col(phase) == "final"))).drop("__only", "__at")


def stream_utilisation(events: DataFrame, stream: str, start: str, stop: str) -> DataFrame:
    """Busy time of each stream over its span; events that overlap count twice."""
    g = events.groupBy(stream).agg(F.sum(F.col(stop) - F.col(start)).alias("busy"), (F.max(stop) - F.min(start)).alias("span"))
    return g.withColumn("utilisation", F.coalesce(F.try_divide("busy", "span"), F.lit(0.0)))


#: Traces that a task holds as Python objects at a time.
TRACES = 256


def nested_spans(events: DataFrame, trace: str, order: str, kind: str, span: str) -> DataFrame:
    """Spans with the span that was open when they began, by list order: trace, span, parent. A trace is one group, and many of them
    are folded in one call."""
    kinds = dict(events.dtypes)
    schema = pa.schema([("trace", to_arrow_schema(events.select(trace).schema).field(0).type), ("span", to_arrow_schema(events.select(span).schema).field(0).type), ("parent", to_arrow_schema(events.select(span).schema).field(0).type)])

    def fold(rows: list[dict]) -> list[tuple]:
        open_: list[list] = []  # [span, whether it is open]
        of: dict = {}
        out = []
        for r in sorted(rows, key=lambda r: (r["at"] is None, r["at"])):
            name = r["span"]
            if r["kind"] == "start":
                while open_ and not open_[-1][1]:
                    open_.pop()
                out.append((name, open_[-1][0] if open_ else None))
                open_.append([name, True])
                of.setdefault(name, []).append(open_[-1])
            elif of.get(name):
                of[name].pop()[1] = False
        return out

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TRACES):
                made = [(g["trace"], *x) for g in batch.slice(at, TRACES).to_pylist() for x in fold(g["events"])]
                columns = zip(*made, strict=True) if made else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    whole = events.groupBy(F.col(trace).alias("trace")).agg(F.collect_list(F.struct(F.col(order).alias("at"), F.col(kind).alias("kind"), F.col(span).alias("span"))).alias("events"))
    return whole.mapInArrow(folded, f"trace {kinds[trace]}, span {kinds[span]}, parent {kinds[span]}").toDF(trace, span, "parent")


def sampled_places(views: DataFrame, size: int) -> DataFrame:
    """`views` (view, numel) with `taken` and the start and stride of the coordinates that are drawn of each: start + j * stride, modulo
    numel, for j under `taken`. Both come from a hash of the view's name; the stride has no divisor in common with numel."""
    digest = F.md5(F.col("view").cast("string"))
    part = lambda k: F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") % F.col("numel")

    @F.pandas_udf("bigint")
    def coprime(stride: pd.Series, numel: pd.Series) -> pd.Series:
        out = []
        for s, n in zip(stride, numel, strict=True):
            s = int(s) or 1
            while math.gcd(s, int(n)) != 1:
                s = (s + 1) % int(n) or 1
            out.append(s)
        return pd.Series(out)

    return views.filter("numel > 0").withColumn("taken", F.least("numel", F.lit(size)).cast("bigint")).withColumn("start", part(0)).withColumn("stride", coprime(part(1), F.col("numel")))


def update_support(deltas: DataFrame, views: DataFrame, size: int, window: int) -> DataFrame:
    """By group and update, how the set of changed coordinates moves: sample_count and the population it stands for, the share that changed,
    the Jaccard overlap with the update before (null without one, 1 if neither changed anything), the mean frequency of change in the
    last `window` updates, the share that never changed in them, and whether the history goes on from the update before.

    `deltas` has (view, update, offset, values): the coordinates from `offset` on; a view may come in any number of such pieces. `views` has
    (view, numel, groups). Of each view `size` coordinates are followed, which weigh as all of it. After a gap in the updates of
    a view its history begins anew. Pieces are cut to the drawn coordinates in the scan, so what is shuffled grows with `size`."""
    drawn = sampled_places(views, size)
    # Where coordinate c stands among the drawn ones: (c - start) / stride, as a product with the inverse of the stride.
    places = drawn.select("view", "groups", "numel", "taken", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("taken") - 1), lambda j: ((F.col("start") + j.cast("decimal(38,0)") * F.col("stride")) % F.col("numel")).cast("bigint"))).alias("coordinate"))
    by_view = places.groupBy("view").agg(F.array_sort(F.collect_list("coordinate")).alias("wanted"))  # `size` numbers a view
    here = F.filter("wanted", lambda c: (c >= F.col("offset")) & (c < F.col("offset") + F.size("values")))
    changes = deltas.join(F.broadcast(by_view), "view").select("view", "update", F.explode(F.transform(here, lambda c: F.struct(c.alias("coordinate"), (F.get("values", (c - F.col("offset")).cast("int")) != 0).alias("changed")))).alias("c")).select("view", "update", "c.*")
    updates = deltas.select("view", "update").distinct()
    before = F.lag("update").over(Window.partitionBy("view").orderBy("update"))
    updates = updates.withColumn("broken", before.isNotNull() & (before != F.col("update") - 1))
    updates = updates.withColumn("run", F.count_if("broken").over(Window.partitionBy("view").orderBy("update")))
    along = Window.partitionBy("view", "coordinate", "run").orderBy("update")
    recent = along.rowsBetween(-(window - 1), 0)
    told = changes.join(updates, ["view", "update"]).select(
        "view", "update", "changed", "broken", F.lag("changed").over(along).alias("previous"), F.avg(F.col("changed").cast("double")).over(recent).alias("frequency"), (~F.bool_or("changed").over(recent)).alias("never")
    )
    weight = F.col("numel") / F.col("taken")
    rows = told.join(F.broadcast(drawn.select("view", "groups", weight.alias("w"))), "view").withColumn("group", F.explode("groups"))
    weighed = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
    known, both, either = F.col("previous").isNotNull(), F.col("previous") & F.col("changed"), F.col("previous") | F.col("changed")
    g = rows.groupBy("group", "update").agg(
        F.count("*").alias("sample_count"), F.sum("w").alias("population"), (weighed(F.col("changed")) / F.sum("w")).alias("changed_share"), weighed(known).alias("__known"), weighed(both).alias("__both"), weighed(either).alias("__either"),
        (F.sum(F.col("w") * F.col("frequency")) / F.sum("w")).alias("window_frequency"), (weighed(F.col("never")) / F.sum("w")).alias("never_changed_share"), (~F.bool_or("broken")).alias("contiguous"),
    )
    jaccard = F.when(F.col("__known") > 0, F.when(F.col("__either") > 0, F.col("__both") / F.nullif("__either", F.lit(0.0))).otherwise(1.0))
    return g.select("group", "update", "sample_count", "population", "changed_share", jaccard.alias("jaccard"), "window_frequency", "never_changed_share", "contiguous")


def rollout_prompts(rollout: Column, batch: int, prompts_per_epoch: int, steps_per_epoch: int) -> Column:
    """Prompts of a rollout; the last of an epoch takes what is left, one beyond it is an error."""
    left = prompts_per_epoch - F.pmod(rollout, F.lit(steps_per_epoch)) * batch
    return F.when(left > 0, F.least(F.lit(batch), left)).otherwise(F.raise_error(F.lit("beyond the epoch")).cast("bigint"))


def updates_before(rollout: Column, batch: int, samples: int, global_batch: int) -> Column:
    if batch * samples % global_batch:
        raise ValueError("the samples of a rollout must be a multiple of the global batch")
    return rollout * (batch * samples // global_batch)


def top_energy_share(histogram: DataFrame, by: list[str], fraction: float) -> DataFrame:
    """Share of the energy in the largest `fraction` of the coordinates, of a histogram (bin, n, energy); the bin on the border
    counts pro rata, an empty or powerless histogram has none."""
    above = Window.partitionBy(*by).orderBy(F.desc(F.coalesce("bin", F.lit(-1)))).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    h = histogram.withColumn("__above", F.coalesce(F.sum("n").over(above), F.lit(0))).withColumn("__n", F.sum("n").over(whole))
    want = F.greatest(F.ceil(F.col("__n") * fraction), F.lit(1))
    take = F.greatest(F.least(F.col("n"), want - F.col("__above")), F.lit(0))
    g = h.withColumn("__take", take).groupBy(*by).agg(F.sum(F.col("energy") * F.col("__take") / F.col("n")).alias("t"), F.sum("energy").alias("e"))
    return g.select(*by, F.try_divide("t", "e").alias("share"))


def smallest_cap(runs: DataFrame, cap: str, seed: str, truncated: str, seeds: list[int], most: float) -> DataFrame:
    """The smallest cap whose mean truncation over exactly the wanted seeds is at most `most`."""
    g = runs.filter(F.col(seed).isin(seeds)).groupBy(cap).agg(F.count_distinct(seed).alias("n"), F.avg(truncated).alias("mean"))
    return g.filter((F.col("n") == len(seeds)) & (F.col("mean") <= most)).agg(F.min(cap).alias("selected"))


def budget_decision(gains: DataFrame, by: list[str], gain: str, slope_low: str, least: float) -> DataFrame:
    """keep where the mean gain is under `least` and the slope may be none, else double."""
    g = gains.groupBy(*by).agg(F.avg(gain).alias("gain"), F.max(slope_low).alias("low"))
    return g.select(*by, "gain", F.when((F.col("gain") < least) & (F.col("low") <= 0), "keep").otherwise("double").alias("decision"))


def kept_or_filled(df: DataFrame, order: str, keep: str, target: int) -> DataFrame:
    """Which groups are used: kept ones in order, and dropped ones only as far as too few are left to reach `target`; those
    asked for beyond it are surplus. Any number of rows; what lies before a row comes from sums over ranges of the order."""
    rows = in_ranges(df, order)
    have = running_sum(rows, F.col(keep).cast("bigint"), "__have", order)
    left = running_sum(have, F.lit(1).cast("bigint"), "__n", order, total="__all")
    asked = left.withColumn("__asked", F.col(keep) | (F.col("__have") + F.col("__all") - F.col("__n") < target))
    used = running_sum(asked, F.col("__asked").cast("bigint"), "__used", order)
    state = F.when(F.col("__asked") & (F.col("__used") <= target), F.when(F.col(keep), "kept").otherwise("filled")).when(F.col(keep), "surplus").otherwise("dropped")
    return used.select(*df.columns, state.alias("state"))


def cumulative_counters(df: DataFrame, step: str, counts: dict[str, Column], after: dict[str, int] | None = None) -> DataFrame:
    """`df` with each of `counts` summed up to and with each row, by `step`. `after` is the last record that was written: its `step` and
    its sums, from which the sums go on. A step that comes twice, or not after that record, is an error."""
    last = (after or {}).get(step)
    seen = df.groupBy(step).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.min(step).alias("least")).first()
    if (seen["most"] or 0) > 1:
        raise ValueError(f"a {step} comes twice")
    if last is not None and seen["least"] is not None and seen["least"] <= last:
        raise ValueError(f"the record ends at {step} {last}, {seen['least']} is a replay")
    rows = in_ranges(df, step)
    for name, value in counts.items():
        rows = running_sum(rows, value, name, step)
        rows = rows.withColumn(name, F.col(name) + (after or {}).get(name, 0))
    return rows.select(*df.columns, *counts)


def routed_rows(df: DataFrame, dataset: str, routes: dict[str, tuple[str, str]]) -> DataFrame:
    """`df` with its `task` and an instruction before the prompt, by dataset; rows of unknown datasets go."""
    pairs = [F.lit(x) for k, (task, _) in routes.items() for x in (k, task)]
    lead = [F.lit(x) for k, (_, text) in routes.items() for x in (k, text)]
    out = df.withColumn("task", F.create_map(*pairs)[F.col(dataset)]).filter(F.col("task").isNotNull())
    return out.withColumn("prompt", F.concat(F.create_map(*lead)[F.col(dataset)], F.col("prompt")))


def single_source(manifest: DataFrame, task: str) -> DataFrame:
    """The one row of the manifest whose name or task is `task`; none or several are an error."""
    found = manifest.filter((F.col("name") == task) | (F.col("task") == task))
    n = found.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} source for {task}")
    return found


def first_configured(*levels: Column) -> Column:
    """The first level that sets a value: data set, defaults, arguments."""
    return F.coalesce(*levels)


def messages_of(nested: Column, prompt: Column) -> Column:
    """The messages of a nested request, or the prompt as one user message."""
    one = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    return F.when(F.size(nested) > 0, nested).otherwise(one)


def batch_source(position: Column, batch: int, choose) -> Column:
    """One source for each batch of positions: `choose` is asked with the batch number."""
    return choose(F.floor(position / batch))


# plain groupings that reports are made of


def status_shares(df: DataFrame, status: str) -> DataFrame:
    """Rows and share of each status; one row for each."""
    g = df.groupBy(status).agg(F.count("*").alias("n"))
    return g.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))


def value_distribution(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (10, 50, 90, 99)) -> DataFrame:
    """count, mean, std, l2, rms, max_abs, negative_fraction and exact percentiles of a value."""
    v = F.col(value)
    g = df.groupBy(*keys).agg(
        F.count("*").alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sqrt(F.sum(v * v)).alias("l2"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("max_abs"),
        F.avg((v < 0).cast("int")).alias("negative_fraction"),
    )
    return g.join(exact_quantiles(df, keys, value, {f"p{q}": q / 100 for q in percents}), keys)


def position_bin(i: Column, length: Column, bins: int = 10) -> Column:
    return F.least(F.lit(bins - 1), F.floor(i * bins / length)).cast("int")


def unequal_siblings(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups whose rows don't all have the same value, nulls included."""
    return df.groupBy(group).agg(F.count_distinct(value).alias("__n"), F.count_if(F.col(value).isNull()).alias("__null")).filter("__n <> 1 or __null > 0").select(group)


def full_groups(df: DataFrame, group: str, size: int, answer: str | None = None) -> DataFrame:
    """Groups of `size` rows or more, of which as many have an answer that isn't blank."""
    said = F.count("*") if answer is None else F.count_if(F.coalesce(F.trim(answer) != "", F.lit(False)))
    return df.groupBy(group).agg(F.count("*").alias("__n"), said.alias("__said")).filter((F.col("__n") >= size) & (F.col("__said") >= size)).select(group)


def common_keys(df: DataFrame, key: str, where: list[Column]) -> DataFrame:
    """Keys that every condition meets."""
    return reduce(DataFrame.intersect, [df.filter(w).select(key) for w in where])


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_anti")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def smallest_hashes(df: DataFrame, branch: str, hashed: Column, key: str, count: int) -> DataFrame:
    """The `count` rows of the smallest hashes of each branch; ties by key."""
    r = F.row_number().over(Window.partitionBy(branch).orderBy(hashed, key))
    return df.withColumn("__r", r).filter(F.col("__r") <= count).drop("__r")


def median_and_iqr(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.select(*keys, "median", (F.col("q3") - F.col("q1")).alias("iqr"))
