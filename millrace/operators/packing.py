"""Micro-batch packing of one training step: small plans over the lengths of a step, one step a row.

A step holds a bounded number of samples (the global batch size), so its samples fit in the arrays of one row; steps are
independent and spread over the cluster.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .lineage import cut
from .ranking import numbered_by


def first_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Each item into the first bin with room; an item beyond `most` has a bin of its own. The first bin with room is found in
    a tree of the most room in each half."""
    size = 1 << max(0, len(lengths) - 1).bit_length()
    room = [most] * (2 * size)  # bins not opened yet are empty
    bins: list[list[int]] = []
    for i, n in enumerate(lengths):
        if n > most:
            at, n = len(bins), most + 1  # nothing fits beside it, not even an empty item
        else:
            node = 1
            while node < size:
                node = 2 * node if room[2 * node] >= n else 2 * node + 1
            at = node - size
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
        node = size + at
        room[node] -= n
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins


def _widest(parts: list[tuple]) -> tuple:
    """A state in the heap, its parts heaviest first: the widest spread comes first, then the one whose heaviest part is greater."""
    parts.sort(reverse=True)
    total, count, items = parts[0]
    return parts[-1][0] - total, -total, -count, [(-i, -n) for i, n in items], parts


def differencing(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """k parts by the largest differencing method, heaviest first: the two states of the widest spread are merged, the heaviest part of
    one with the lightest of the other. Parts compare by their sum, then their number of items, then the items (index and
    length) in the order in which they came together. With `equal_size` states begin with k items each, in order of
    length, so parts have equally many; a number of items that k doesn't divide is an error."""
    if equal_size and len(lengths) % k:
        raise ValueError(f"{len(lengths)} items can't make {k} parts of one size")
    by_length = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    each = k if equal_size else 1
    single = [(lengths[i], 1, ((i, lengths[i]),)) for i in by_length]
    heap = [_widest(single[at : at + each] + [(0, 0, ())] * (k - each)) for at in range(0, len(single), each)]
    heapq.heapify(heap)
    while len(heap) > 1:
        one, two = heapq.heappop(heap), heapq.heappop(heap)
        other = two[4]
        heapq.heappush(heap, _widest([(p[0] + q[0], p[1] + q[1], p[2] + q[2]) for p, q in zip(one[4], reversed(other), strict=True)]))
    return [[i for i, _ in items] for _, _, items in heap[0][4]] if heap else [[] for _ in range(k)]


def greedy(lengths: list[int], k: int) -> list[list[int]]:
    """Items in the given order, each to the lightest part."""
    heap, parts = [(0, i) for i in range(k)], [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        total, at = heapq.heappop(heap)
        parts[at].append(i)
        heapq.heappush(heap, (total + n, at))
    return parts


def split_bin(items: list[int], lengths: list[int]) -> tuple[list[int], list[int]]:
    """Longest first (of equal ones the earlier), each to the lighter half, the first at a tie; halves keep that order."""
    halves, totals = ([], []), [0, 0]
    for i in sorted(items, key=lambda i: -lengths[i]):
        h = int(totals[0] > totals[1])
        halves[h].append(i)
        totals[h] += lengths[i]
    return halves


def expanded(bins: list[list[int]], count: int, lengths: list[int]) -> list[list[int]]:
    """The heaviest bin of two or more items (the last of equal ones) is split until there are `count`, or none is left to split. The first
    half takes its place, the second goes to the end."""
    bins = [list(b) for b in bins]
    heap = [(-sum(lengths[i] for i in b), -k) for k, b in enumerate(bins) if len(b) > 1]
    heapq.heapify(heap)
    while len(bins) < count and heap:
        k = -heapq.heappop(heap)[1]
        bins[k], other = split_bin(bins[k], lengths)
        bins.append(other)
        for at in (k, len(bins) - 1):
            if len(bins[at]) > 1:
                heapq.heappush(heap, (-sum(lengths[i] for i in bins[at]), -at))
    return bins


def balanced(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """k parts by differencing, each in order of its items. Fewer items than parts, and a part without items, are errors."""
    if len(lengths) < k:
        raise ValueError(f"{len(lengths)} items are fewer than {k} parts")
    parts = [sorted(p) for p in differencing(lengths, k, equal_size)]
    if not all(parts):
        raise ValueError("a part has no item")
    return parts


def chunked(sizes: list[int], limit: int) -> list[list[int]]:
    """Neighbouring items; a chunk ends before the item with which it would reach `limit`."""
    chunks: list[list[int]] = []
    total = 0
    for i, n in enumerate(sizes):
        if not chunks or total + n >= limit:
            chunks.append([])
            total = 0
        chunks[-1].append(i)
        total += n
    return chunks


def micro_batches(lengths: list[int], weights: list[float], most: int, mode: str, size: int) -> list[list[int]]:
    """dynamic: first fit by length; balanced: as many bins as the tokens fill at least, their weights (operations) evened by
    differencing, which doesn't hold them to `most`; fixed: `size` neighbours each."""
    if mode == "fixed":
        return [list(range(at, min(at + size, len(lengths)))) for at in range(0, len(lengths), size)]
    if mode == "dynamic":
        return first_fit(lengths, most)
    count = max(1, -(-sum(lengths) // most))
    return balanced(weights, count) if count < len(lengths) else [[i] for i in range(len(lengths))]


def aligned(bins: list[list[int]], lengths: list[int], multiple: int, splits: bool) -> list[list[int]]:
    """As many bins as a multiple of `multiple`. Where that takes more, the heaviest are split, if they may be; else it is an error."""
    count = max(1, -(-len(bins) // multiple)) * multiple
    grown = expanded(bins, count, lengths) if splits else bins
    if len(grown) != count:
        raise ValueError(f"{len(lengths)} samples in {len(grown)} micro-batches, {count} are needed")
    return grown


def dealt_bins(weights: list[float], ranks: int, even: bool) -> list[list[int]]:
    """The bins of each rank, as many for each: by differencing their weights, or in turn."""
    return balanced(weights, ranks, equal_size=True) if even else [list(range(r, len(weights), ranks)) for r in range(ranks)]


def step_plan(lengths: list[int], weights: list[float], ranks: int, most: int, mode: str, size: int, group: int, even: bool) -> list[tuple[int, int, int]]:
    """(micro_batch, rank, place) of each sample of a step: bins by `micro_batches`, as many as a multiple of ranks times `group`, dealt
    to the ranks. `place` counts a rank's samples micro-batch by micro-batch. A step with fewer samples than ranks is an error."""
    if len(lengths) < ranks:
        raise ValueError(f"{len(lengths)} samples are fewer than {ranks} ranks")
    bins = aligned(micro_batches(lengths, weights, most, mode, size), lengths, ranks * group, mode != "fixed")
    out: list = [None] * len(lengths)
    for r, own in enumerate(dealt_bins([sum(weights[i] for i in b) for b in bins], ranks, even)):
        for place, (b, i) in enumerate((b, i) for b in own for i in bins[b]):
            out[i] = (b, r, place)
    return out


def packed_steps(
    df: DataFrame, step: str, order: str, length: str, ranks: int, most: int, mode: str = "dynamic", size: int = 8, weight: str | None = None, group: int = 1, even: bool = True
) -> DataFrame:
    """(step, order, micro_batch, rank, place) of each sample by `step_plan`; `weight` (operations, else the length) is what is evened."""

    def made(lengths: list, weights: list) -> list[tuple]:
        return step_plan([int(x) for x in lengths], weights, ranks, most, mode, size, group, even)

    return _planned(_by_step(df, step, order, length, weight or length), step, order, made, ["micro_batch", "rank", "place"])


#: Samples of which a task holds the plans as Python objects at a time.
HELD = 1 << 16


def _planned(g: DataFrame, step: str, order: str, made: Callable[[list, list], list[tuple]], names: list[str]) -> DataFrame:
    """(step, order, and numbers by `names`) of each sample of the rows of `_by_step`; plans leave a task by pieces of HELD samples."""
    first = g.select(F.col(step).alias("step"), F.col("s.__order").alias("order"), F.col("s.__length").alias("length"), F.col("s.__weight").alias("weight"))
    spread = first.select("step", F.explode("order").alias("order"), *[F.lit(0).alias(n) for n in names])
    schema = to_arrow_schema(spread.schema)

    def piece(batch: pa.RecordBatch, start: int, numbers: list[list[tuple]]) -> pa.RecordBatch:
        own = batch.slice(start, len(numbers))
        steps = own.column(0).take(pa.array([i for i, found in enumerate(numbers) for _ in found], pa.int64()))
        columns = [[x[k] for found in numbers for x in found] for k in range(len(names))]
        arrays = [steps.cast(schema.field(0).type), own.column(1).flatten().cast(schema.field(1).type), *[pa.array(c, pa.int32()) for c in columns]]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, numbers = 0, 0, []
            for i in range(batch.num_rows):
                numbers.append(made(batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))
                held += len(numbers[-1])
                if held >= HELD or i + 1 == batch.num_rows:
                    yield piece(batch, start, numbers)
                    start, held, numbers = i + 1, 0, []

    return first.mapInArrow(plan, spread.schema).toDF(step, order, *names)


def _by_step(df: DataFrame, step: str, order: str, length: str, weight: str) -> DataFrame:
    """One row a step, its samples in order; a step is a bounded batch."""
    one = F.struct(F.col(order).alias("__order"), F.col(length).alias("__length"), F.col(weight).alias("__weight"))
    return df.groupBy(step).agg(F.array_sort(F.collect_list(one)).alias("s"))


def grouped_plan(df: DataFrame, step: str, order: str, length: str, make, name: str = "part", sized: bool = False) -> DataFrame:
    """(step, order, `name`) by a plan over the lengths of each step, such as `first_fit`, `balanced`, `greedy` or `chunked`; with the
    length, a whole number, if `sized`."""

    def made(lengths: list, _: list) -> list[tuple]:
        part = {i: k for k, items in enumerate(make([int(x) for x in lengths])) for i in items}
        return [(part[i], n) if sized else (part[i],) for i, n in enumerate(lengths)]

    return _planned(_by_step(df, step, order, length, length), step, order, made, [name, length] if sized else [name])


def per_rank(assigned: DataFrame, rows: DataFrame, keys: list[str], step: str = "step") -> DataFrame:
    """What each rank of a step is sent: its rows in order of place, as arrays of one row for (step, rank)."""
    columns = [c for c in rows.columns if c not in keys]
    both = assigned.join(rows, keys)
    g = both.groupBy(step, "rank").agg(F.array_sort(F.collect_list(F.struct("place", "micro_batch", *columns))).alias("s"))
    return g.select(step, "rank", *[F.col(f"s.{c}").alias(c) for c in ("micro_batch", *columns)])


def steps(df: DataFrame, rollout: str, position: str, rollouts_a_step: int) -> DataFrame:
    """Steps by the first occurrence of each rollout; a trailing incomplete step is dropped."""
    first = df.groupBy(rollout).agg(F.min(position).alias("__first"))
    numbered = numbered_by(first, "__n", "__first", [rollout])
    total = first.count() // rollouts_a_step
    numbered = numbered.select(rollout, F.floor(F.col("__n") / rollouts_a_step).alias("step")).filter(F.col("step") < total)
    return df.join(numbered, rollout)


def inverse_permutation(p: Column) -> Column:
    """Where each of 0..n-1 stands in `p`."""
    return F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (F.array_position(p, i) - 1).cast("int"))


def forward_flops(tokens: Column, hidden: int, layers: int, ffn: int, vocabulary: int) -> Column:
    """Projections, causal attention and the output layer of a dense decoder, two operations a weight."""
    linear = 2 * layers * (4 * hidden * hidden + 3 * hidden * ffn) + 2 * hidden * vocabulary
    return tokens * float(linear) + 2.0 * layers * hidden * tokens * tokens


def training_schedule(df: DataFrame, rollout: str, position: str, length: str, rollouts_a_step: int, ranks: int, most: int, **how) -> DataFrame:
    """(step, rollout, position, micro_batch, rank, place) of each sample that is trained: steps of whole rollouts by first occurrence,
    in which samples stand rollout by rollout, packed and dealt by `packed_steps`. Fewer rollouts than one step are an error."""
    staged = cut(steps(df.select(rollout, position, length), rollout, position, rollouts_a_step))
    if staged.isEmpty():
        raise ValueError("there are fewer rollouts than a step takes")
    first = F.min(position).over(Window.partitionBy("step", rollout))
    return packed_steps(staged.withColumn("order", F.struct(first.alias("first"), F.col(rollout), F.col(position))), "step", "order", length, ranks, most, **how).select("step", f"order.{rollout}", f"order.{position}", "micro_batch", "rank", "place")
