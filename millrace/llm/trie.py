"""A prefix trie of rebuilt conversations, merged family by family.

A family are the conversations whose ids belong to one base id. Families are cogrouped with the opening turns of their base
conversation, rebuilt, and turned into small tries; only the combined nodes of those are shuffled to be merged. A node is
told by 128 bits that hold every turn of its path with its place, so equal paths of different families meet by key.

The smallest member of a node is also the smallest of all nodes below it on its own path. So the nodes of one smallest member form a
chain, and sums over subtrees need no rounds: a running sum along each chain, and the sum of the chain sent once to every
node above it, for a family at a time.

Turns beyond `SLICE` of one conversation, which can be any number, are walked in slices whose running hash is carried on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import joined_to_counted, release, written

#: Ids of a family, and the largest share of a base conversation that others take over (less one).
FAMILY, OPENING = 5, 9
#: Families in one group of the cogroup, and turns of a conversation in one slice.
KIN, SLICE = 64, 4096
#: 2^BLOCK ids of members are joined before they are hashed.
BLOCK = 12

NODE = "slice bigint, base bigint, depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, bytes bigint, members array<bigint>, goes_on boolean, ends array<bigint>, carried array<bigint>"
FAR = "slice bigint, base bigint, conv bigint, depth bigint, x1 bigint, x2 bigint, bytes bigint, last boolean"
KEY = ["depth", "k1", "k2"]


def base_of(conv: Column) -> Column:
    return conv - conv % FAMILY


def share_of(conv: Column) -> Column:
    """How many turns of its base conversation a conversation takes over."""
    return F.crc32(conv.cast("string")) % OPENING


def placed(turns: DataFrame) -> DataFrame:
    """(conv, at, a, b, bytes): each turn with its place in its conversation, two hashes of role and text, and the length of the text.

    Rows are dealt out by ranges of conversation and turn, so a conversation of any length is spread, and numbered in each;
    what lies before comes from one row for each (range, conversation), of which at most one a range has anything before it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").alias("turn"), F.substring(role, 1, 64).alias("r"), F.substring(text, 1, 64).alias("t"), F.md5(F.concat(role, F.lit("\x00"), text)).alias("m"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), F.octet_length(text).cast("bigint").alias("bytes"),
    )
    order = ["conv", "turn", "r", "t", "m"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "a", "b", "bytes", F.monotonically_increasing_id().alias("row"))
    rows = written(sorted_rows.withColumn("part", F.shiftright("row", 33)), "turns")
    parts = rows.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    here = F.row_number().over(Window.partitionBy("conv", "part").orderBy("row")) - 1
    joined = rows.withColumn("here", here.cast("bigint")).join(F.broadcast(before.filter("before IS NOT NULL").select("conv", "part", "before")), ["conv", "part"], "left")
    return joined.select("conv", (F.col("here") + F.coalesce("before", F.lit(0))).alias("at"), "a", "b", "bytes")


def _mixed(z):
    import numpy as np

    z = z ^ (z >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z = z ^ (z >> np.uint64(27))
    z = z * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _hashes(at, a, b):
    """Two hashes of a turn at its place."""
    import numpy as np

    at, a, b = at.astype(np.uint64), a.view(np.uint64), b.view(np.uint64)
    one = np.uint64(1)
    return _mixed(a + _mixed(b + _mixed(at + one))), _mixed(b + _mixed(a + _mixed(at + np.uint64(0x9E3779B97F4A7C15))))


def _along(x, first):
    """Running exclusive-or, begun anew where `first` says so."""
    import numpy as np

    total = np.bitwise_xor.accumulate(x) if len(x) else x
    starts = np.flatnonzero(first)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0)) if len(starts) else total[:0]
    return total ^ np.repeat(before, np.diff(np.append(starts, len(x))))


def _family_tries(own, opening):
    """The tries of some families: `own` has their turns (conv, base, share, at, a, b, bytes), `opening` the first turns of their bases.

    The turn at place SLICE, if there is one, only says that the conversation goes on."""
    import numpy as np
    import pyarrow as pa

    col = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, np.int64)
    conv, base, share, at, a, b, size = (col(own, c) for c in ("conv", "base", "share", "at", "a", "b", "bytes"))
    # Conversations, and for each how many turns its base can give.
    convs, where = np.unique(conv, return_index=True)
    of, takes = base[where], share[where]
    o_base, o_at = col(opening, "base"), col(opening, "at")
    order = np.lexsort((o_at, o_base))
    o_base, o_at, o_a, o_b, o_size = o_base[order], o_at[order], *(col(opening, c)[order] for c in ("a", "b", "bytes"))
    low = np.searchsorted(o_base, of, "left")
    given = np.minimum(np.searchsorted(o_base, of, "right") - low, takes)
    # Rebuilt: the opening, then what is left of each own part.
    copied = np.repeat(np.arange(len(convs)), given)
    place = np.arange(len(copied)) - np.repeat(np.cumsum(given) - given, given)
    taken = np.repeat(low, given) + place
    mine = np.searchsorted(convs, conv)
    far = np.zeros(len(convs), bool)
    far[mine[at == SLICE]] = True
    keep = (at >= share) & (at < SLICE)
    who = np.concatenate([copied, mine[keep]])
    at = np.concatenate([place, (at - share + given[mine])[keep]]).astype(np.int64)
    a, b, size = (np.concatenate([x[taken], y[keep]]) for x, y in ((o_a, a), (o_b, b), (o_size, size)))
    order = np.lexsort((at, who))
    who, at, a, b, size = (x[order] for x in (who, at, a, b, size))
    first = np.append(True, who[1:] != who[:-1]) if len(who) else np.zeros(0, bool)
    h1, h2 = _hashes(at, a, b)
    k1, k2 = _along(h1, first), _along(h2, first)
    p1, p2 = (np.where(first, np.uint64(0), np.append(np.uint64(0), k[:-1])) if len(k) else k for k in (k1, k2))
    # With the root of each conversation.
    none = np.zeros(len(convs), np.uint64)
    who, depth = np.concatenate([np.arange(len(convs)), who]), np.concatenate([np.zeros(len(convs), np.int64), at + 1])
    k1, k2, p1, p2 = (np.concatenate([none, k]) for k in (k1, k2, p1, p2))
    size = np.concatenate([np.zeros(len(convs), np.int64), size])
    length = np.zeros(len(convs), np.int64)
    np.maximum.at(length, who, depth)
    ends = depth == length[who]
    order = np.lexsort((who, k2, k1, depth, of[who]))
    who, depth, k1, k2, p1, p2, size, ends = (x[order] for x in (who, depth, k1, k2, p1, p2, size, ends))
    family = of[who]
    new = np.append(True, (family[1:] != family[:-1]) | (depth[1:] != depth[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) if len(who) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    lists = lambda which: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(group[which], minlength=len(starts)))).astype(np.int32)), pa.array(convs[who[which]]))
    goes_on = np.zeros(len(starts), bool)
    goes_on[group[~ends | far[who]]] = True
    signed = lambda k: pa.array(k[starts].view(np.int64))
    return pa.table({
        "slice": pa.array(np.zeros(len(starts), np.int64)), "base": pa.array(family[starts]), "depth": pa.array(depth[starts]), "k1": signed(k1), "k2": signed(k2), "p1": signed(p1), "p2": signed(p2),
        "bytes": pa.array(size[starts]), "members": lists(np.ones(len(who), bool)), "goes_on": pa.array(goes_on), "ends": lists(ends & ~far[who]), "carried": lists(ends & far[who]),
    })


def _far_slice(turns):
    """A slice of one long conversation (conv, base, slice, at in the rebuilt one, a, b, bytes): running hashes from its start."""
    import numpy as np
    import pyarrow as pa

    turns = turns.sort_by("at")
    col = {c: turns.column(c).combine_chunks().to_numpy() for c in turns.column_names}
    h1, h2 = _hashes(col["at"], col["a"], col["b"])
    n = len(h1)
    signed = lambda h: pa.array(np.bitwise_xor.accumulate(h).view(np.int64))
    return pa.table({"slice": turns["slice"], "base": turns["base"], "conv": turns["conv"], "depth": pa.array(col["at"] + 1), "x1": signed(h1), "x2": signed(h2), "bytes": turns["bytes"], "last": pa.array(np.arange(n) == n - 1)})


def family_nodes(turns: DataFrame) -> DataFrame:
    """The combined nodes of all families, as NODE says, written."""
    rows = written(placed(turns).select("conv", base_of(F.col("conv")).alias("base"), share_of(F.col("conv")).alias("share"), "at", "a", "b", "bytes"), "placed")
    kin = F.floor(F.col("base") / (FAMILY * KIN))
    near = rows.filter(F.col("at") <= SLICE).withColumn("kin", kin)
    opening = rows.filter((F.col("conv") == F.col("base")) & (F.col("at") < OPENING - 1)).withColumn("kin", kin)
    nodes = written(near.groupBy("kin").cogroup(opening.groupBy("kin")).applyInArrow(_family_tries, NODE), "near-nodes")
    ends = nodes.filter(F.size("carried") > 0).select(F.explode("carried").alias("conv"), "depth", "k1", "k2")
    if ends.isEmpty():  # no conversation goes beyond one slice
        release(rows)
        return nodes
    far = rows.filter(F.col("at") >= SLICE).withColumn("slice", F.floor(F.col("at") / SLICE))
    slices = far.select("conv", "slice").distinct().join(ends, "conv")
    shift = slices.select("conv", "slice", (F.col("depth") - SLICE).alias("shift"))
    walk = far.join(shift, ["conv", "slice"]).select("slice", "base", "conv", (F.col("at") + F.col("shift")).alias("at"), "a", "b", "bytes")
    walked = written(walk.groupBy("conv", "slice").applyInArrow(_far_slice, FAR), "far-walk")
    along = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = walked.filter("last").select("conv", "slice", "x1", "x2").join(slices.select("conv", "slice", "k1", "k2"), ["conv", "slice"])
    carry = totals.select("conv", "slice", *[F.coalesce(F.bit_xor(f"x{i}").over(along), F.lit(0)).bitwiseXOR(F.col(f"k{i}")).alias(f"c{i}") for i in (1, 2)], F.max("slice").over(Window.partitionBy("conv")).alias("final"))
    within = Window.partitionBy("conv", "slice").orderBy("depth")
    far_nodes = walked.join(carry, ["conv", "slice"]).select(
        "slice", "base", "depth", *[F.col(f"x{i}").bitwiseXOR(F.col(f"c{i}")).alias(f"k{i}") for i in (1, 2)], *[F.coalesce(F.lag(f"x{i}").over(within), F.lit(0)).bitwiseXOR(F.col(f"c{i}")).alias(f"p{i}") for i in (1, 2)],
        "bytes", F.array("conv").alias("members"), (~F.col("last") | (F.col("slice") < F.col("final"))).alias("goes_on"), F.when(F.col("last") & (F.col("slice") == F.col("final")), F.array("conv")).otherwise(F.expr("cast(array() AS array<bigint>)")).alias("ends"),
        F.expr("cast(array() AS array<bigint>)").alias("carried"),
    )
    out = written(nodes.unionByName(far_nodes), "nodes")
    release(rows, nodes, walked)
    return out


def _digests(batches: Iterator) -> Iterator:
    """The hash of each node's blocks of ids, which come in order; a node may go on from batch to batch and is never held whole."""
    import pyarrow as pa

    at, digest = None, None
    for batch in batches:
        found: list[tuple] = []
        for key in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if key[:3] != at:
                if digest is not None:
                    found.append((*at, digest.hexdigest()))
                at, digest = key[:3], hashlib.sha256(key[3].encode())
            else:
                digest.update(b"," + key[3].encode())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=[*KEY, "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, digest.hexdigest())], names=[*KEY, "ends_sha256"])


def end_digests(nodes: DataFrame) -> DataFrame:
    """(KEY, ends_sha256) of nodes at which a conversation ends. Ids are joined in blocks of their values first."""
    ends = nodes.select(*KEY, F.explode("ends").alias("conv"))
    ids = F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",")
    blocks = ends.groupBy(*KEY, F.shiftright("conv", BLOCK).alias("block")).agg(ids.alias("ids"))
    blocks = written(blocks.withColumn("blocks", F.count("*").over(Window.partitionBy(*KEY))), "blocks")
    one = blocks.filter("blocks = 1").select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    many = blocks.filter("blocks > 1").select(*KEY, "block", "ids").repartition(*KEY).sortWithinPartitions(*KEY, "block")
    return one.unionByName(many.drop("block").mapInArrow(_digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"))


def merged(nodes: DataFrame) -> DataFrame:
    """The nodes of all families as one trie: KEY, parent's key, conv (the smallest member), n, bytes and leaf."""
    return nodes.groupBy(*KEY).agg(
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.min(F.array_min("members")).alias("conv"), F.sum(F.size("members")).alias("n"), F.max("bytes").alias("bytes"), (~F.bool_or("goes_on")).alias("leaf")
    )


def _upwards(rows: DataFrame) -> DataFrame:
    """Sums of `saves` and `leaves` of each node of a chain (conv) with all nodes below it in the chain; `tops` adds the chain's start."""
    piece = F.floor(F.col("depth") / SLICE)
    below = Window.partitionBy("conv", "piece").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    deeper = Window.partitionBy("conv").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("piece", piece)
    later = rows.groupBy("conv", "piece").agg(F.sum("saves").alias("s"), F.sum("leaves").alias("l"), F.min("depth").alias("d"))
    later = later.select(F.col("conv").alias("of"), F.col("piece").alias("in"), F.coalesce(F.sum("s").over(deeper), F.lit(0)).alias("s"), F.coalesce(F.sum("l").over(deeper), F.lit(0)).alias("l"), F.min("d").over(Window.partitionBy("conv")).alias("top"))
    summed = rows.withColumns({"saves": F.sum("saves").over(below), "leaves": F.sum("leaves").over(below)}).join(later, (F.col("conv") == F.col("of")) & (F.col("piece") == F.col("in")))
    return summed.withColumns({"saves": F.col("saves") + F.col("s"), "leaves": F.col("leaves") + F.col("l")}).drop("of", "in", "s", "l", "piece")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie over all rebuilt conversations of `turns` (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Turns stand in order of
    `turn`, null first; equal ones by role, the first 64 characters of the text, and a hash of both. A null role or text is
    empty. Rows without an id belong to no conversation. Repeated rows are turns of their own. An empty table has no node.
    Other columns are ignored. Long texts are read once and travel as hashes."""
    nodes = family_nodes(turns)
    trie = written(merged(nodes).withColumn("saves", (F.col("n") - 1) * F.col("bytes")).withColumn("leaves", F.col("leaf").cast("bigint")), "trie", nodes.rows)
    chains = written(_upwards(trie), "chains", trie.rows)
    # What a chain holds goes to the nodes above it on the path of its conversation, for each family at once.
    starts = chains.filter((F.col("depth") == F.col("top")) & (F.col("top") > 0)).select("conv", "top", "saves", "leaves")
    slices = F.explode(F.sequence(F.lit(0), F.floor((F.col("top") - 1) / SLICE) + 1)).alias("slice")
    totals = starts.select(base_of(F.col("conv")).alias("base"), slices, F.struct("conv", "top", "saves", "leaves").alias("chain")).groupBy("base", "slice").agg(F.collect_list("chain").alias("chains"))
    above = nodes.join(totals.withColumn("slice", F.col("slice").cast("bigint")), ["base", "slice"]).withColumn("under", F.expr("filter(chains, c -> c.top > depth AND array_contains(members, c.conv))")).filter(F.size("under") > 0)
    from_below = above.select(*KEY, *[F.expr(f"aggregate(under, 0L, (s, c) -> s + c.{c})").alias(c) for c in ("saves", "leaves")])
    children = trie.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("children"))
    children = written(children, "children", trie.rows)
    tops = chains.filter((F.col("depth") == F.col("top")) & (F.col("top") > 0)).select(F.col("depth").alias("own_depth"), F.col("k1").alias("own_k1"), F.col("k2").alias("own_k2"), (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    names = written(trie.select(*KEY, F.col("conv").alias("parent")).join(children.withColumnRenamed("children", "times"), KEY), "parents", trie.rows)
    tops = written(tops, "tops", trie.rows)
    parents = joined_to_counted(tops, names, KEY, max(1, tops.rows)).select(F.col("own_depth").alias("depth"), F.col("own_k1").alias("k1"), F.col("own_k2").alias("k2"), "parent")
    digests = end_digests(nodes)
    kinds = {"conv": "bigint", "n": "bigint", "parent": "bigint", "children": "bigint", "saves": "bigint", "leaves": "bigint", "ends_sha256": "string"}
    shaped = lambda df: df.select(*KEY, *[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    own = chains.withColumn("parent", F.when(F.col("depth") > F.col("top"), F.col("conv")))
    facts = shaped(own).unionByName(shaped(from_below)).unionByName(shaped(children)).unionByName(shaped(parents)).unionByName(shaped(digests))
    whole = facts.groupBy(*KEY).agg(*[(F.sum(c) if c in ("children", "saves", "leaves") else F.max(c)).alias(c) for c in kinds])
    return whole.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saves").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: The checksum has no function there: its table of 256 values is made bit by bit, and each id goes through it byte by byte.
TRIE_SQL = """
WITH RECURSIVE bits AS (
  SELECT n::BIGINT AS k, n::BIGINT AS v, 0 AS bit FROM range(256) x(n)
  UNION ALL SELECT k, CASE WHEN v % 2 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, bit + 1 FROM bits WHERE bit < 8
), cells AS (SELECT list(v ORDER BY k) AS cell FROM bits WHERE bit = 8),
ids AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 5 AS b FROM conversations WHERE conv_id IS NOT NULL),
shares AS (
  SELECT c, b, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(cell[xor(a, x) % 256 + 1], a >> 8))) % 9 AS h
  FROM ids, cells
), said AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(coalesce(role, ''), 64), left(coalesce(text, ''), 64), md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), parts AS (
  SELECT s.c, 0 AS part, b.i, b.r, b.t FROM shares s JOIN said b ON b.c = s.b AND b.i <= s.h
  UNION ALL SELECT s.c, 1, o.i, o.r, o.t FROM shares s JOIN said o ON o.c = s.c AND o.i > s.h
), rebuilt AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, r, t FROM parts),
paths AS (
  SELECT c, d, list({'r': r, 't': t}) OVER (PARTITION BY c ORDER BY d) AS path, strlen(t) AS size FROM rebuilt
  UNION ALL SELECT c, 0, [], 0 FROM ids
), members AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM paths),
nodes AS (
  SELECT d, path, min(c) AS conv, count(*) AS n, max(size) AS size, bool_and(ends) AS leaf, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY d, path
), below AS (
  SELECT m.d, m.path, sum((u.n - 1) * u.size)::BIGINT AS saved, count(*) FILTER (u.leaf) AS leaves, count(*) FILTER (u.d = m.d + 1) AS children
  FROM nodes u JOIN members m ON m.c = u.conv AND m.d <= u.d GROUP BY m.d, m.path
)
SELECT v.conv AS conv_id, v.d::BIGINT AS depth, p.conv AS parent_conv_id, v.n AS n_convs, b.children AS n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, v.ends_sha256
FROM nodes v JOIN below b ON b.d = v.d AND b.path = v.path LEFT JOIN nodes p ON p.d = v.d - 1 AND p.path = v.path[:v.d - 1]
"""
