"""SimHash near-duplicates: fingerprints of whole texts, linked by a self-join of binary tries.

Equal fingerprints are one node of the graph. The tries are walked in blocks: a task gets the subtrees of two
prefixes that may still hold partners, walks pairs of nodes together from there, adds up differing bits and
prunes a pair once it has more than its budget. A task returns a spanning forest of what it linked, never all
pairs, and the forests are joined into components by rounds of star contraction on Spark.

The same fingerprints are walked several times, each time from another block of bits. Two fingerprints that differ
in at most `budget` bits differ in at most budget // walks bits of one of those blocks, so each walk may
prune at that many within the block that it starts with and at `budget` in all; together they miss no pair.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_to_counted, release, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Subtrees are told apart by this many leading bits at most; it must not exceed the width of a block, 64 // walks.
PREFIX_BITS = 16


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    """Over half of the hashes of all shingles of `width` words decide each bit."""
    import xxhash

    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-1].tolist()], (ends - 1).tolist()
    if len(words) > width:
        starts, stops = starts[: len(words) - width + 1], stops[width - 1 :]
    else:
        starts, stops = [0], [len(line)]
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), len(starts)
    for at in range(0, n, 1 << 15):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)])], dtype=np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprinted(docs: DataFrame, width: int = 4) -> DataFrame:
    """All columns of `docs` and `fp`, the signed 64-bit fingerprint. A null text is empty."""

    @F.pandas_udf("bigint")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in text], dtype=np.uint64).view(np.int64))

    return docs.withColumn("fp", fp("text"))


def components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index reachable from each of `n`, over links a-b and what `label` joins already."""
    label = np.arange(n) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


class Walk:
    """Pairs of trie nodes over sorted distinct keys; a node is a range of them that agree in their first bits. Pairs whose
    members are all in one component already have nothing to add and aren't followed."""

    def __init__(self, keys: np.ndarray, budget: int, block: int, block_budget: int):
        self.keys, self.budget, self.block, self.block_budget = keys, budget, block, block_budget
        self.label = np.arange(len(keys))

    def run(self, depth: int, spans: np.ndarray, leaf: int = 8, chunk: int = 1 << 18) -> np.ndarray:
        """`spans`: rows of (from, to, from, to), node pairs at `depth`; a node may stand beside itself."""
        todo = [(depth, spans)]
        while todo:
            depth, s = todo.pop()
            if len(s) > chunk:
                todo += [(depth, s[at : at + chunk]) for at in range(0, len(s), chunk)]
                continue
            s = self.open(s)
            small = ((s[:, 1] - s[:, 0] <= leaf) & (s[:, 3] - s[:, 2] <= leaf)) | (depth == 64)
            self.compare(s[small])
            if not small.all():
                todo.append((depth + 1, self.children(s[~small], depth)))
        return self.label

    def open(self, s: np.ndarray) -> np.ndarray:
        """The pairs whose members aren't all in one component."""
        changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
        uniform = (changes[s[:, 0]] == changes[s[:, 1] - 1]) & (changes[s[:, 2]] == changes[s[:, 3] - 1])
        alone = (s[:, 0] == s[:, 2]) & (s[:, 1] - s[:, 0] == 1)
        return s[~(alone | uniform & (self.label[s[:, 0]] == self.label[s[:, 2]]))]

    def children(self, s: np.ndarray, depth: int) -> np.ndarray:
        """Child pairs whose prefixes of depth + 1 bits may still be within budget."""
        one = np.uint64(1) << np.uint64(63 - depth)
        low = ~((one << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
        mid = [np.searchsorted(self.keys, (self.keys[s[:, k]] & low) | one) for k in (0, 2)]
        parts = []
        for x in (0, 1):
            for y in (0, 1):
                c = np.stack([s[:, 0] if x == 0 else mid[0], mid[0] if x == 0 else s[:, 1], s[:, 2] if y == 0 else mid[1], mid[1] if y == 0 else s[:, 3]], axis=1)
                twice = (s[:, 0] == s[:, 2]) & (x > y)  # the pair of a node's own children, met before
                parts.append(c[(c[:, 0] < c[:, 1]) & (c[:, 2] < c[:, 3]) & ~twice])
        c = np.concatenate(parts)
        d = (self.keys[c[:, 0]] ^ self.keys[c[:, 2]]) & ~(one - np.uint64(1))
        ok = np.bitwise_count(d) <= self.budget
        ok &= np.bitwise_count(d >> np.uint64(64 - self.block)) <= self.block_budget
        return c[ok]

    def compare(self, s: np.ndarray, most: int = 1 << 21) -> None:
        """Links among all members of small nodes."""
        if not len(s):
            return
        sizes = np.cumsum((s[:, 1] - s[:, 0]) * (s[:, 3] - s[:, 2]))
        cuts = [0, *np.unique(np.searchsorted(sizes, np.arange(most, sizes[-1] + most, most), side="right")).tolist(), len(s)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                a, b = self.members(s[lo:hi])
                near = np.bitwise_count(self.keys[a] ^ self.keys[b]) <= self.budget
                self.label = components(len(self.label), a[near], b[near], self.label)

    @staticmethod
    def members(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = s[:, 3] - s[:, 2]
        size = (s[:, 1] - s[:, 0]) * m
        k = np.repeat(np.arange(len(s)), size)
        at = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
        a, b = s[k, 0] + at // m[k], s[k, 2] + at % m[k]
        return a[a != b], b[a != b]


def turned(keys: np.ndarray, by: int) -> np.ndarray:
    return keys if by == 0 else (keys << np.uint64(by)) | (keys >> np.uint64(64 - by))


def subtrees(counts: np.ndarray, block_rows: int) -> np.ndarray:
    """For each prefix of PREFIX_BITS bits the depth of its subtree: the shallowest that holds at most `block_rows`."""
    depth = np.full(len(counts), PREFIX_BITS)
    for d in range(PREFIX_BITS, -1, -1):
        held = counts.reshape(1 << d, -1).sum(axis=1)
        depth[np.repeat(held <= block_rows, len(counts) >> d)] = d
    return depth


def partners(trees: DataFrame, depths: list[int], within: int) -> DataFrame:
    """Pairs (walk, low, high) of subtrees (walk, own, depth), each given by its first prefix, that differ in at most `within` of the bits that
    both fix. Every subtree looks up the prefixes with so few bits flipped among those that are as deep or less deep."""
    flips = [(d, sum(1 << k for k in ks)) for d in depths for r in range(within + 1) for ks in combinations(range(PREFIX_BITS - d, PREFIX_BITS), r)]
    flips = trees.sparkSession.createDataFrame(flips, "at int, flip int")  # some hundred for each of at most 17 depths
    start = F.col("own").bitwiseAND(F.expr(f"shiftleft(-1, {PREFIX_BITS} - at)")).bitwiseXOR(F.col("flip"))
    asked = trees.join(F.broadcast(flips), F.col("at") <= F.col("depth")).select("walk", "own", F.col("at").alias("depth"), start.cast("int").alias("other"))
    met = asked.join(trees.select("walk", "depth", F.col("own").alias("other")), ["walk", "depth", "other"])
    return met.select("walk", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).distinct()


def linked_nodes(nodes: DataFrame, budget: int = 4, walks: int = 3, block_rows: int = 1 << 17) -> DataFrame:
    """Edges (a, b) between `nodes` (node, fp: distinct fingerprints) that connect what is within `budget` bits: forests,
    not all pairs. `nodes` is read several times, so it should be a written table.

    Each walk cuts its trie into subtrees of at most `block_rows` fingerprints, deeper only where it is dense, and a task
    gets a pair of subtrees. The driver sees 2^16 counts for each walk, whatever the input."""
    width, within, bits = 64 // walks, budget // walks, PREFIX_BITS
    turned_fp = F.when(F.col("walk") == 0, F.col("fp")).otherwise(F.expr(f"shiftleft(fp, walk * {width}) | shiftrightunsigned(fp, 64 - walk * {width})"))
    placed = nodes.withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks - 1)))).withColumn("prefix", F.shiftrightunsigned(turned_fp, 64 - bits).cast("int"))
    counts = np.zeros((walks, 1 << bits), dtype=np.int64)
    seen = placed.groupBy("walk", "prefix").count().toArrow().to_pandas()
    counts[seen["walk"], seen["prefix"]] = seen["count"]
    parts = []
    for walk in range(walks):
        used = np.flatnonzero(counts[walk])
        depth = subtrees(counts[walk], block_rows)[used]
        own, at = np.unique(used >> (bits - depth) << (bits - depth), return_index=True)
        parts.append(pd.DataFrame({"walk": walk, "own": own, "depth": depth[at]}))
    parts = pd.concat(parts).astype("int32")
    depths = sorted(map(int, parts["depth"].unique()))
    trees = nodes.sparkSession.createDataFrame(pa.Table.from_pandas(parts, preserve_index=False))
    meets = written(partners(trees, depths, within), "meets", len(parts))
    meets = meets.select("walk", F.col("low").alias("own"), "low", "high").unionByName(meets.filter("low <> high").select("walk", F.col("high").alias("own"), "low", "high"))
    at_depth = placed.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))) if depths else placed.withColumn("depth", F.lit(0))
    at_depth = at_depth.withColumn("own", F.col("prefix").bitwiseAND(F.expr(f"shiftleft(-1, {bits} - depth)")))
    own = at_depth.join(F.broadcast(trees), ["walk", "depth", "own"])  # at most walks * 2^16 subtrees, one of them holds a prefix
    pairs = own.join(meets, ["walk", "own"]).select("node", "fp", "walk", "low", "high", "own", "depth")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        turn, low, high = (int(group[c].iloc[0]) for c in ("walk", "low", "high"))
        keys = turned(group["fp"].to_numpy().astype(np.int64).view(np.uint64), turn * width)
        order = np.argsort(keys, kind="stable")
        keys, node, mine, depth = keys[order], group["node"].to_numpy()[order], group["own"].to_numpy()[order], group["depth"].to_numpy()[order]
        none = pd.DataFrame({"a": np.array([], dtype=np.int64), "b": np.array([], dtype=np.int64)})
        cut = int(np.searchsorted(mine, low, side="right")) if low != high else len(keys)
        if low != high and cut in (0, len(keys)):
            return none
        start = np.array([[0, cut, 0, cut]] if low == high else [[0, cut, cut, len(keys)]])
        # A deeper subtree is one node at the depth of the shallower one, too.
        label = Walk(keys, budget, width, within).run(int(depth.min()), start)
        child = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": node[child], "b": node[label[child]]}) if len(child) else none

    return pairs.groupBy("walk", "low", "high").applyInPandas(walk, "a bigint, b bigint")


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link: root is the smallest of its component. Large-star and
    small-star rounds, each written, until nothing changes; joins on hot centres can be split by AQE."""
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.count("*").alias("times"), F.least(F.min("b"), F.first("a")).alias("m")), "star-least", 2 * e.rows)
        large = joined_to_counted(both, least, ["a"], 2 * e.rows).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), "star-large", 2 * e.rows)
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lows.select("a", F.col("m").alias("b")))
        last, e = e, written(small.filter("a <> b").distinct(), "star", 4 * e.rows)
        release(last, least, large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def named_components(nodes: DataFrame, roots: DataFrame, least: str) -> DataFrame:
    """`nodes` (node, ...) with `component`, the smallest `least` of all nodes that share a root. A root of many nodes is split."""
    placed = written(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed-nodes", getattr(nodes, "rows", None))
    names = written(placed.groupBy("root").agg(F.count("*").alias("times"), F.min(least).alias("component")), "components", placed.rows)
    return joined_to_counted(placed, names, ["root"], placed.rows).drop("times", "root")


def near_duplicates(docs: DataFrame, width: int = 4, budget: int = 4, walks: int = 3, label: str = "doc_id", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all, if not given), with `fp` and `component_id`, the smallest `label` in the
    component.

    Documents are linked if their fingerprints differ in at most `budget` bits. A null or blank text has fingerprint zero
    and is linked like any other. Null ids take part; a component without any id has a null component_id. Repeated rows and
    ties share a component. An empty table gives an empty result; columns named fp or component_id are replaced.
    """
    kept = [c for c in (keep or docs.columns) if c not in ("fp", "component_id")]
    rows = fingerprinted(docs.drop("fp", "component_id"), width).select(*[F.col(f"`{c}`") for c in kept], "fp")
    rows = written(rows, "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(f"`{label}`").alias("least_id"), F.count("*").alias("copies")).withColumn("node", F.col("fp")), "fingerprint-nodes")
    roots = star_components(linked_nodes(nodes.select("node", "fp"), budget, walks))
    named = named_components(nodes, roots, "least_id").select("fp", F.col("copies").alias("times"), F.col("component").alias("component_id"))
    return joined_to_counted(rows, written(named, "named-fingerprints"), ["fp"], rows.rows).select(*[F.col(f"`{c}`") for c in kept], "fp", "component_id")


def linked_documents(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs.select("doc_id", "text"), keep=("doc_id",))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
