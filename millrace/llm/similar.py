"""Near-duplicates by shingle similarity: candidates by SimHash tries and min-hashes, every link verified exactly.

Texts with the same set of shingles are one node. The tries of operator 4 propose the nodes whose fingerprints are near; at a
similarity of 0.8 two fingerprints differ in 9.7 of 64 bits on average, with a deviation of 2.9, so a budget that misses
few such pairs would be 18 bits, where the tries no longer prune and one in 4000 unrelated pairs is a candidate. So pairs in
different components that agree in one band of min-hashes are candidates, too; with 30 bands of five, a pair of similarity
0.8 is missed once in about 150,000 times and a closer one more rarely. No candidate is a link before the similarity of
the two whole sets has been computed.

Pairs within one component need no check. The members of a bucket that still lie in different components meet in one task
with their sets, which counts what all of them share at once and returns a forest of the links, so no pair is ever a row.
A large bucket is first compared with one of its members, which joins most of a group of near copies; what is left of it
meets block by block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, joined_to_counted, numbered, release, written
from .simhash import LOWER, WORD, components, linked_nodes, named_components, star_components

#: A block of a bucket has at most about so many nodes, and so many hashes in their sets; a task holds two blocks.
BLOCK_ROWS, BLOCK_HASHES = 1024, 1 << 20


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of `width` words, in order; a shorter text is one shingle, one without words has the
    shingle zero."""
    import xxhash

    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return np.zeros(1, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-1].tolist()], (ends - 1).tolist()
    if len(words) > width:
        starts, stops = starts[: len(words) - width + 1], stops[width - 1 :]
    else:
        starts, stops = [0], [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts, stops)], dtype=np.uint64))


def sketched(docs: DataFrame, width: int, bands: int, each: int) -> DataFrame:
    """`docs` with `sketch`: 128 bits of the set of shingles (h1, h2), its size n, its fingerprint fp (each bit decided by
    over half of the shingles) and a key for each band."""
    rng = np.random.default_rng(8)
    turn, times, mix = (rng.integers(0, 1 << 63, bands * each, dtype=np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(3))

    @F.pandas_udf("h1 bigint, h2 bigint, n int, fp bigint, keys array<bigint>")
    def sketch(text: pd.Series) -> pd.DataFrame:
        import xxhash

        out = []
        for t in text:
            h = shingles(t, width)
            d = xxhash.xxh3_128_intdigest(h.tobytes())
            least, votes = np.full(len(times), ~np.uint64(0)), np.zeros(64, dtype=np.int64)
            for at in range(0, len(h), 2048):
                x = (h[at : at + 2048] ^ (h[at : at + 2048] >> np.uint64(29)))[:, None]
                least = np.minimum(least, ((x ^ turn) * times).min(axis=0))
                votes += np.unpackbits(h[at : at + 2048].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            keys = ((least ^ least >> np.uint64(31)) * mix).reshape(bands, each).sum(axis=1, dtype=np.uint64).view(np.int64)
            fp = int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.int64)[0])
            out.append(((d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63), len(h), fp, keys))
        return pd.DataFrame(out, columns=["h1", "h2", "n", "fp", "keys"])

    return docs.withColumn("sketch", sketch("text"))


def shingle_sets(needed: DataFrame, nodes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(node, h): the sets of shingles of the `needed` nodes, as a written table. A node's text is that of its row `at.row`."""

    @F.pandas_udf("array<bigint>")
    def hashes(text: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width).view(np.int64) for t in text])

    needed = needed.distinct().join(nodes.select("node", F.col("at.row").alias(ROW)), "node")
    return written(rows.select(ROW, "text").join(needed, ROW).select("node", hashes("text").alias("h")), "shingle-sets")


def similar_pairs(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """The `pairs` (a, b) of nodes whose sets of shingles have a similarity of `least` or more."""
    sets = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, rows, width)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("y")), "b")
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("same"))
    found = written(both.filter(F.col("same") / (F.col("n") - F.col("same")) >= least).select("a", "b"), "links")
    release(sets)
    return found


def shared_counts(sets: list[np.ndarray], columns: int = 4096, most: int = 1 << 21) -> np.ndarray:
    """How many values each two of the `sets` share. Values that many sets hold are columns of a matrix, others are counted
    pair by pair."""
    m, sizes = len(sets), [len(x) for x in sets]
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    held = np.diff(np.append(starts, len(values)))
    same, often = np.zeros((m, m)), np.flatnonzero(held > max(1, m // 32))
    for at in range(0, len(often), columns):
        k = often[at : at + columns]
        column = np.repeat(np.arange(len(k)), held[k])
        places = np.arange(len(column)) + np.repeat(starts[k] - np.cumsum(held[k]) + held[k], held[k])
        x = np.zeros((m, len(k)), dtype=np.float32)
        x[owner[places], column] = 1
        same += x @ x.T
    for d in range(2, m // 32 + 1):
        k = starts[held == d]
        for at in range(0, len(k), most // (d * d)):
            who = owner[k[at : at + most // (d * d), None] + np.arange(d)]
            np.add.at(same.reshape(-1), (who[:, :, None] * m + who[:, None, :]).reshape(-1), 1)
    return same


def forest(part: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) that join the components `part` wherever two of the `sets` have a similarity of `least` or more."""
    _, first, which = np.unique(part, return_index=True, return_inverse=True)
    own = first[which]
    n, same = np.array([len(x) for x in sets], dtype=np.float64), shared_counts(sets)
    near = np.triu(same / (n[:, None] + n - same) >= least, 1)
    label = components(len(own), *np.nonzero(near), own.copy())
    moved = np.flatnonzero((own == np.arange(len(own))) & (label != own))
    return moved, label[moved]


def bucket_links(at: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, least: float, hashes: int) -> DataFrame:
    """Edges (a, b) that join the components `part` of the members of each bucket (key, node, part, blocks) of which two are similar:
    forests, not all pairs. Small buckets share a group of rows, each two blocks of a large one are a group. All
    buckets together have `hashes` hashes."""
    sets = shingle_sets(at.select("node"), nodes, rows, width)
    piles = 1 + max(hashes // BLOCK_HASHES, at.rows // BLOCK_ROWS)
    block, one = F.pmod(F.xxhash64("node"), "blocks"), F.col("blocks") == 1
    beside = F.when(one, F.array(F.lit(0).cast("bigint"))).otherwise(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda x: x != F.col("block")))
    placed = at.withColumn("block", block).withColumn("other", F.explode(beside))
    placed = placed.select("key", "node", "part", F.when(one, F.pmod("key", F.lit(piles))).otherwise(F.col("key")).alias("pile"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.array([], dtype=np.int64)], [np.array([], dtype=np.int64)]
        for _, bucket in group.groupby("key", sort=False):
            node = bucket["node"].to_numpy()
            x, y = forest(bucket["part"].to_numpy(), bucket["h"].tolist(), least)
            a.append(node[x])
            b.append(node[y])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    found = placed.join(sets, "node").groupBy("pile", "low", "high").applyInPandas(meet, "a bigint, b bigint")
    found = written(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    release(sets)
    return found


def linked(nodes: DataFrame, rows: DataFrame, width: int, least: float, budget: int, walks: int, rounds: int = 2) -> DataFrame:
    """(node, root) for every one of `nodes` (node, at, n, fp, keys) that is similar to another, root being the smallest of
    its component. `nodes` and `rows` are read several times."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    near = linked_nodes(prints.select("node", "fp"), budget, walks)
    same = nodes.select("fp", F.col("node").alias("a")).join(prints.withColumnRenamed("node", "b"), "fp").filter("a <> b").select("a", "b")
    pairs = near.unionByName(same).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tried = written(pairs, "candidates")
    links = similar_pairs(tried, nodes, rows, width, least)
    roots = written(star_components(links), "parts")
    at = nodes.select("node", "n", F.explode("keys").alias("key"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_HASHES)).alias("blocks")
    for turn in range(rounds + 1):
        # Only buckets that hold several components have pairs left.
        at = at.join(roots.select("node", F.col("root").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
        mixed = at.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), blocks).filter("low < high").select("key", "blocks")
        at = written(at.join(mixed, "key"), "buckets")
        if not at.rows:
            return roots
        most, hashes = at.agg(F.max("blocks"), F.sum("n")).first()
        if most == 1 or turn == rounds:
            break
        large = at.filter("blocks > 1")
        there = large.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("part").alias("other"))
        first = F.min(F.struct(F.xxhash64(F.lit(turn), "b").alias("by"), "b", "m", "other")).alias("f")
        there = there.groupBy("key").agg(F.count("*").alias("times"), first).select("key", "times", "f.b", "f.m", "f.other")
        pairs = joined_to_counted(large, written(there, "bucket-firsts"), ["key"], at.rows)
        pairs = pairs.filter("part <> other").filter(F.least("n", "m") >= F.greatest("n", "m") * least)
        pairs = pairs.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "candidates")
        found = similar_pairs(pairs, nodes, rows, width, least)
        tried, links = tried.unionByName(pairs), links.unionByName(found)
        if found.rows:
            roots = written(star_components(links), "parts")
        at = at.drop("part", "blocks")
    found = bucket_links(at, nodes, rows, width, least, hashes)
    return written(star_components(links.unionByName(found)), "parts") if found.rows else roots


def without_similar(
    docs: DataFrame, order: str = "doc_id", width: int = 5, least: float = 0.8, budget: int = 8, walks: int = 4, bands: int = 30, each: int = 5
) -> DataFrame:
    """The rows of `docs` of which no earlier one (by `order`, nulls first, then as read) is in the same component of texts
    with a shingle similarity of `least` or more. Texts without a word are equal, null texts are such. Repeated rows are
    copies, of which one stays. An empty table gives an empty result. A column named __row is left out, others may have any name."""
    rows = numbered(docs)
    here = F.struct(F.col(f"`{order}`").alias("by"), F.col(ROW).alias("row")).alias("at")
    marks = written(sketched(rows.select(here, "text"), width, bands, each).select("at", "sketch.*"), "sketches")
    nodes = marks.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "sketch-nodes")
    roots = linked(nodes, rows, width, least, budget, walks)
    named = named_components(nodes.select("h1", "h2", "copies", "at", "node"), roots, "at").select("h1", "h2", F.col("copies").alias("times"), F.col("component").alias("first"))
    firsts = joined_to_counted(marks.select("at", "h1", "h2"), written(named, "named-sketches"), ["h1", "h2"], marks.rows)
    gone = written(firsts.filter(F.col("at") != F.col("first")).select(F.col("at.row").alias(ROW)), "later-copies")
    return rows.join(gone, ROW, "left_anti").drop(ROW)
