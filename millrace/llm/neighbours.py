"""Nearest neighbours through vantage-point trees: one over regions of space, and one in each shard.

A tree over a bounded sample deals all vectors to regions; a region of many vectors is cut into shards, each with a tree of
its own that is built once and written. A query first asks the shards of its own region, which bounds the distance of its
k-th neighbour, and then those of the regions that the triangle inequality can't rule out at that bound. With `factor` 1 no
neighbour can be missed; a larger factor prunes as if the bound were that much smaller, which is faster and approximate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, written


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows by one product of matrices; off by rounding, about 1e-8 of the norms."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0))


class VantageTree:
    """Rows in the order of the leaves. Inner nodes: a vantage point, the median distance to it, what lies within and what
    beyond; a leaf is a range of rows. Nodes are rows of (point, near, far, from, to), with point -1 in leaves."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray, nodes: np.ndarray, mids: np.ndarray):
        self.vectors, self.order, self.nodes, self.mids, self.computed = vectors, order, nodes, mids, 0
        self.scale = 1 + float(np.sqrt((vectors * vectors).sum(axis=1).max())) if len(vectors) else 1.0

    def slack(self, queries: np.ndarray) -> np.ndarray:
        """More than rounding may add to a distance."""
        return 1e-6 * (self.scale + np.sqrt((queries * queries).sum(axis=1)))

    @classmethod
    def build(cls, vectors: np.ndarray, leaf: int = 256, seed: int = 6) -> VantageTree:
        rng, order, nodes, mids, done = np.random.default_rng(seed), [], [], [], 0
        todo = [(np.arange(len(vectors)), -1, 0)]
        while todo:
            at, parent, side = todo.pop()
            here = len(nodes)
            if parent >= 0:
                nodes[parent][side] = here
            split = cls.split(vectors, at, rng) if len(at) > leaf else None
            if split is None:
                nodes.append([-1, -1, -1, done, done + len(at)])
                mids.append(0.0)
                order.append(at)
                done += len(at)
                continue
            point, mid, near = split
            nodes.append([point, -1, -1, -1, -1])
            mids.append(mid)
            todo += [(at[~near], here, 2), (at[near], here, 1)]
        order = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        nodes = np.array(nodes, dtype=np.int64).reshape(-1, 5)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        inner = nodes[:, 0] >= 0
        nodes[inner, 0] = place[nodes[inner, 0]]
        return cls(vectors[order], order, nodes, np.array(mids))

    @staticmethod
    def split(vectors: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> tuple[int, float, np.ndarray] | None:
        """The vantage point of widest spread among a few, the median distance, and who lies within. None for equal vectors."""
        pick, some = rng.choice(at, size=min(8, len(at)), replace=False), rng.choice(at, size=min(64, len(at)), replace=False)
        point = int(pick[np.argmax(distances(vectors[pick], vectors[some]).var(axis=1))])
        d = distances(vectors[point : point + 1], vectors[at])[0]
        mid = float(np.median(d))
        near = d <= mid
        if near.all():  # more than half lie at one distance
            near = d < mid
            if not near.any():
                return None
            mid = float(d[near].max())
        return point, mid, near

    def leaves(self, queries: np.ndarray, reach: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows of the queries that it can't be ruled out for at a distance of `reach`)."""
        out, todo = [], [(0, np.arange(len(queries)))] if len(self.nodes) else []
        reach = reach + self.slack(queries)
        while todo:
            k, rows = todo.pop()
            point, near, far, _, _ = self.nodes[k]
            if point < 0:
                out.append((k, rows))
                continue
            gap = distances(queries[rows], self.vectors[point : point + 1])[:, 0] - self.mids[k]
            todo += [(near, rows[gap <= reach[rows]]), (far, rows[-gap <= reach[rows]])]
            todo = [t for t in todo if len(t[1])]
        return out

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, exact distance) of the `k` nearest of each query, or those nearer than `within`; `ids` are of the
        tree's rows, and a row with the query's `own` id is no candidate."""
        n, slack = len(queries), self.slack(queries)
        within = np.full(n, np.inf) if within is None else within
        best, found = np.repeat(within[:, None], k, axis=1), []
        todo = [(0, np.arange(n))] if len(self.nodes) else []
        gaps: dict[int, np.ndarray] = {}
        while todo:  # nearer sides are on top; the others are looked at again when their turn comes
            node, rows = todo.pop()
            if node < 0:
                node, side = divmod(-node - 1, 2)
                gap = gaps[node][rows]
                rows = rows[np.abs(gap) <= best[rows, -1] / factor + slack[rows]]
                node = self.nodes[node, 1 + side]
                if not len(rows):
                    continue
            point, near, far, lo, hi = self.nodes[node]
            if point >= 0:
                gap = distances(queries[rows], self.vectors[point : point + 1])[:, 0] - self.mids[node]
                gaps.setdefault(node, np.zeros(n))[rows] = gap
                self.computed += len(rows)
                inside, outside = rows[gap <= 0], rows[gap > 0]
                # Marked as -(2 * node + side) - 1: the side across the border, which may be pruned by then.
                todo += [(-(2 * node + 1) - 1, inside), (-(2 * node) - 1, outside), (near, inside), (far, outside)]
                todo = [t for t in todo if len(t[1])]
                continue
            for at in range(lo, hi, 1024):
                v, vid = self.vectors[at : min(at + 1024, hi)], ids[at : min(at + 1024, hi)]
                for some in np.array_split(rows, max(1, len(rows) // 1024)):
                    self.computed += len(some) * len(v)
                    near_by = (distances(queries[some], v) <= best[some, -1:] + slack[some, None]) & (own[some][:, None] != vid)
                    i, j = np.nonzero(near_by)
                    if not len(i):
                        continue
                    exact = np.sqrt(((queries[some[i]] - v[j]) ** 2).sum(axis=1))
                    found.append((some[i], vid[j], exact))
                    d = np.full(near_by.shape, np.inf)
                    d[i, j] = exact
                    hit = np.flatnonzero(near_by.any(axis=1))
                    best[some[hit]] = np.sort(np.partition(np.concatenate([best[some[hit]], d[hit]], axis=1), k - 1, axis=1)[:, :k], axis=1)
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        row, vid, d = (np.concatenate(x) for x in zip(*found))
        keep = d <= best[row, -1]
        row, vid, d = row[keep], vid[keep], d[keep]
        order = np.lexsort((vid, d, row))
        row, vid, d = row[order], vid[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        return row[place < k], vid[place < k], d[place < k]


class Regions:
    """Which region of space a vector lies in, by the trees of the samples of each dimension."""

    def __init__(self, trees: dict[int, VantageTree]):
        self.trees = trees
        self.region = {d: {int(leaf): k for k, leaf in enumerate(np.flatnonzero(t.nodes[:, 0] < 0))} for d, t in trees.items()}

    def reached(self, dim: int, vectors: np.ndarray, reach: np.ndarray) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in vectors]
        if dim not in self.trees:
            return [[0] for _ in vectors]
        for leaf, rows in self.trees[dim].leaves(vectors, reach):
            for r in rows.tolist():
                out[r].append(self.region[dim][leaf])
        return out

    def home(self, dim: int, vectors: np.ndarray) -> np.ndarray:
        if dim not in self.trees:
            return np.zeros(len(vectors), dtype=np.int32)
        tree, out, todo = self.trees[dim], np.zeros(len(vectors), dtype=np.int32), [(0, np.arange(len(vectors)))]
        while todo:
            k, rows = todo.pop()
            point, near, far, _, _ = tree.nodes[k]
            if point < 0:
                out[rows] = self.region[dim][k]
                continue
            inside = distances(vectors[rows], tree.vectors[point : point + 1])[:, 0] <= tree.mids[k]
            todo += [t for t in ((near, rows[inside]), (far, rows[~inside])) if len(t[1])]
        return out


def regions_of(ready: DataFrame, counts: dict[int, int], shard_rows: int, sample: int) -> Regions:
    """Trees over at most about `sample` vectors of each dimension that has over `shard_rows`; a region holds 16 sampled
    vectors at least."""
    trees = {}
    for dim, n in counts.items():
        if n <= shard_rows:
            continue
        drawn = ready.filter(F.col("dim") == dim).select("vec_id", "embedding").filter(F.pmod(F.xxhash64(F.lit(6), "vec_id", "embedding"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)))
        rows = drawn.distinct().orderBy(F.xxhash64(F.lit(6), "vec_id", "embedding")).limit(2 * sample).collect()
        if len(rows) > 32:
            leaf = max(16, -(-len(rows) * shard_rows // n))
            trees[dim] = VantageTree.build(np.array([r["embedding"] for r in sorted(rows)], dtype=float), leaf=leaf)
    return Regions(trees)


def nearest(
    vectors: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0, shard_rows: int = 8192, query_block: int = 1024, sample: int = 4096
) -> DataFrame:
    """The `k` nearest of each query: query_id, rank (from 1), vec_id, score (Euclidean distance).

    `vectors` has vec_id and embedding; queries are the rows whose vec_id is divisible by `every`, candidates
    all rows but those with the query's own vec_id. Null, empty, zero vectors and those with null or non-finite
    components take no part, nor do null ids; vectors of different length are never compared. Ties go to the
    smaller vec_id; a repeated candidate counts as often as it occurs, while a repeated query id asks once, with
    its shortest and smallest vector. Fewer candidates than `k` are all
    returned (with factor 1). An empty table gives an empty result; further columns are ignored. A task holds one shard (about
    `shard_rows` vectors, dealt by row within a region, so equal vectors or ids don't meet in one) and about `query_block`
    queries at a time.
    """
    e = F.col("embedding")
    usable = (
        F.col("vec_id").isNotNull()
        & (F.size(e) > 0)
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        & F.exists(e, lambda x: x != 0)
    )
    ready = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.cast("array<double>").alias("embedding")).filter(usable)
    ready = ready.withColumn("dim", F.size("embedding"))
    counts = {r["dim"]: r["count"] for r in ready.groupBy("dim").count().collect()}
    sent = vectors.sparkSession.sparkContext.broadcast(regions_of(ready, counts, shard_rows, sample))

    def by_dim(dims: pd.Series, vectors: pd.Series):
        for dim in dims.unique():
            rows = np.flatnonzero(dims == dim)
            yield int(dim), rows, np.stack(vectors.iloc[rows].to_numpy()).astype(float)

    @F.pandas_udf("int")
    def home(dims: pd.Series, vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(dims), dtype=np.int32)
        for dim, rows, v in by_dim(dims, vectors):
            out[rows] = sent.value.home(dim, v)
        return pd.Series(out)

    @F.pandas_udf("array<int>")
    def reached(dims: pd.Series, vectors: pd.Series, reach: pd.Series) -> pd.Series:
        out = np.empty(len(dims), dtype=object)
        for dim, rows, v in by_dim(dims, vectors):
            for r, found in zip(rows, sent.value.reached(dim, v, reach.to_numpy()[rows] / factor)):
                out[r] = found
        return pd.Series(out)

    placed = written(ready.withColumn("region", home("dim", "embedding")).withColumn("row", F.monotonically_increasing_id()), "vectors-placed")
    sizes = placed.groupBy("dim", "region").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    sizes = written(sizes, "regions")  # one row for each region
    shard = F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")
    packed = placed.join(F.broadcast(sizes), ["dim", "region"]).withColumn("shard", shard).groupBy("dim", "region", "shard")
    packed = packed.agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows")).select("dim", "region", "shard", F.col("rows.vec_id").alias("ids"), F.flatten("rows.embedding").alias("flat"))

    @F.pandas_udf("ids array<bigint>, flat array<double>, nodes array<bigint>, mids array<double>")
    def grown(dims: pd.Series, ids: pd.Series, flat: pd.Series) -> pd.DataFrame:
        out = []
        for dim, i, f in zip(dims, ids, flat):
            tree = VantageTree.build(np.asarray(f, dtype=float).reshape(-1, dim))
            out.append((np.asarray(i)[tree.order], tree.vectors.ravel(), tree.nodes.ravel(), tree.mids))
        return pd.DataFrame(out, columns=["ids", "flat", "nodes", "mids"])

    trees = written(packed.select("dim", "region", "shard", grown("dim", "ids", "flat").alias("t")).select("dim", "region", "shard", "t.*"), "vector-trees")
    asked = placed.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "embedding", "region")).alias("one")).select("vec_id", "one.*")
    asked = written(asked, "queries")
    keys = ["dim", "region", "shard", "block"]

    def answer(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or held.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        dim, one = int(queries["dim"].iloc[0]), held.iloc[0]
        v = np.asarray(one["flat"], dtype=float).reshape(-1, dim)
        tree = VantageTree(v, np.arange(len(v)), np.asarray(one["nodes"]).reshape(-1, 5), np.asarray(one["mids"], dtype=float))
        q, own = np.stack(queries["embedding"].to_numpy()).astype(float), queries["vec_id"].to_numpy()
        row, ids, d = tree.search(q, own, np.asarray(one["ids"]), k, factor, queries["reach"].to_numpy().astype(float))
        return pd.DataFrame({"query_id": own[row], "vec_id": ids, "score": d})

    def ask(queries: DataFrame) -> DataFrame:
        """`queries` (vec_id, dim, embedding, region, reach): what all shards of these regions hold within reach."""
        at = queries.join(F.broadcast(sizes), ["dim", "region"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        load = at.groupBy("dim", "region", "shard").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
        load = written(load, "query-load")  # one row for each shard
        at = at.join(load, ["dim", "region", "shard"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        held = trees.join(load, ["dim", "region", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return at.select(*keys, "vec_id", "embedding", "reach").groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(answer, "query_id bigint, vec_id bigint, score double")

    near = written(ask(asked.withColumn("reach", F.lit(float("inf")))), "near-hits")
    reach = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("score")).alias("d"))
    reach = reach.select("vec_id", F.when(F.col("n") >= k, F.get("d", F.lit(k - 1))).alias("reach"))
    bound = asked.join(reach, "vec_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    others = bound.withColumn("at", F.explode(reached("dim", "embedding", "reach"))).filter("at <> region").drop("region").withColumnRenamed("at", "region")
    hits = written(near.unionByName(ask(written(others, "queries-onward"))), "hits")
    release(placed, asked, near, trees)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
