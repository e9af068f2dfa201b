"""Line deduplication by a suffix array over line ids, in DataFrame functions only.

Every line is a symbol, every position of a document a suffix. Distributed prefix doubling ranks the blocks of 1, 2, 4, ...
lines that begin at each suffix: the rank of a block is the place of the ranks of its two halves among all such
pairs. A suffix whose block occurs nowhere else is alone and leaves, and the rounds end when all are alone, so the ranks
that a suffix had, one after the other, are its place in the suffix array.

An interval of the array whose longest common prefix is B lines or more is the set of suffixes that begin with the same B
lines. Its first suffix in reading order is the source, all others begin a copy of B lines. The rounds give the intervals
at powers of two; those between are found by descending: within the interval of 2^k lines, suffixes that part before
2^(k+1) lines are compared by the ranks of what follows, which are the intervals at 2^k + 2^j lines, j < k, and so on
with ever smaller powers. The deepest interval in which a suffix isn't the source is its longest earlier copy, and the
copies that no other holds are the maximal repeated runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW, joined_to_counted, numbered, release, written


def here() -> Column:
    return F.struct("doc", "at")


def lines_of(rows: DataFrame, offsets: bool) -> DataFrame:
    """doc, at (line number from 0), two hashes of the line; with `offsets` also where it starts and stops in the text."""
    cut = rows.filter(F.col("text").isNotNull()).select(F.struct(F.col("doc_id").alias("by"), F.col(ROW).alias("row")).alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    line = F.trim("line")
    slim = cut.select("doc", "at", F.xxhash64(line).alias("left"), F.xxhash64(line, F.lit(1)).alias("right"), (F.length("line") + 1).cast("bigint").alias("n"))
    if not offsets:
        return slim.drop("n")
    return slim.withColumn("stop", F.sum("n").over(Window.partitionBy("doc").orderBy("at"))).withColumn("start", F.col("stop") - F.col("n")).drop("n")


def ranked(blocks: DataFrame, label: str) -> DataFrame:
    """The suffixes whose block (`left`, `right`) occurs more than once: doc, at, `rank` in the order of (left, right) and
    `first`, the earliest of them. Counts and minima are made before the shuffle, blocks that are common are split."""
    names = blocks.groupBy("left", "right").agg(F.count("*").alias("times"), F.min(here()).alias("first")).filter("times > 1")
    names = names.repartitionByRange("left", "right").sortWithinPartitions("left", "right").withColumn("rank", F.monotonically_increasing_id())
    names = written(names, f"ranks-{label}", blocks.rows)
    found = written(joined_to_counted(blocks, names, ["left", "right"], blocks.rows).drop("left", "right", "times"), f"suffixes-{label}", blocks.rows)
    release(names)
    return found


def doubled(level: DataFrame, size: int) -> DataFrame:
    """Blocks of twice `size` lines as pairs of the ranks of their halves, where both halves occur elsewhere."""
    ahead = Window.partitionBy("doc").orderBy("at").rangeBetween(size, size)
    return level.select("doc", "at", F.col("rank").alias("left"), F.first("rank").over(ahead).alias("right")).filter(F.col("right").isNotNull())


def suffix_levels(lines: DataFrame) -> list[DataFrame]:
    """For 1, 2, 4, ... lines: the suffixes whose block isn't alone, with `rank` and `first`."""
    levels = [ranked(lines, "1")]
    while levels[-1].rows:
        size = 1 << (len(levels) - 1)
        blocks = written(doubled(levels[-1], size), "blocks", levels[-1].rows)
        levels.append(ranked(blocks, str(2 * size)))
        release(blocks)
    return levels


def histories(levels: list[DataFrame]) -> DataFrame:
    """doc, at and `steps`: for each level in which the suffix isn't alone its rank and the first suffix of the same rank."""
    steps = reduce(DataFrame.unionAll, [x.select("doc", "at", F.struct(F.lit(k).alias("k"), "rank", "first").alias("s")) for k, x in enumerate(levels)])
    return written(steps.groupBy("doc", "at").agg(F.array_sort(F.collect_list("s")).alias("steps")), "histories", sum(x.rows for x in levels))


def copies_between(history: DataFrame) -> list[DataFrame]:
    """Copies (doc, at, lines, source) in the intervals at depths between powers of two, as written tables.

    A node is an interval; its members are the earliest suffix of each of its parts that go on differently. What follows
    the `shared` lines of a member has ranks in `below` levels that still may agree with those of another."""
    parting = F.filter(F.sequence(F.lit(1), F.size("steps") - 1), lambda k: F.coalesce(F.get("steps", k + 1)["first"] == here(), F.lit(True)))
    members = history.filter(F.size("steps") > 1).select("doc", "at", "steps", F.explode(parting).alias("below"))
    node = F.struct(F.col("below").cast("bigint").alias("a"), F.get("steps", F.col("below"))["rank"].alias("b"))
    work, found = written(members.select("doc", "at", "below", F.expr("shiftleft(1, below)").alias("shared"), node.alias("node")), "members", 4 * history.rows), []
    ranks = history.select("doc", "at", F.col("steps.rank").alias("ranks"))
    key = ["node", "shared", "j", "rank"]
    while work.rows:
        wanted = work.select("doc", (F.col("at") + F.col("shared")).alias("at"), F.col("at").alias("start"), "below", "shared", "node")
        follow = wanted.hint("merge").join(ranks, ["doc", "at"]).select("doc", F.col("start").alias("at"), "shared", "node", F.slice("ranks", 1, F.col("below")).alias("ranks"))
        after = F.get("ranks", F.col("j") + 1).alias("after")
        placed = written(follow.select("*", F.posexplode("ranks").alias("j", "rank")).select("doc", "at", *key, after), "members-placed", 4 * work.rows)
        nodes = written(placed.groupBy(*key).agg(F.count("*").alias("times"), F.min(here()).alias("first")).filter("times > 1"), "nodes", placed.rows)
        inside = written(joined_to_counted(placed, nodes, key, placed.rows), "members-inside", placed.rows)
        depth = F.col("shared") + F.expr("shiftleft(1, j)")
        found.append(inside.filter(here() != F.col("first")).select("doc", "at", depth.alias("lines"), F.col("first").alias("source")))
        # Of members that share the next power of two as well only the earliest goes on: they part in a deeper interval.
        going = inside.filter("j > 0 and after is not null").groupBy(*key, "after").agg(F.min(here()).alias("one")).select(*key, "one.*")
        going = going.unionByName(inside.filter("j > 0 and after is null").select(*key, "doc", "at"))
        node = F.struct(F.xxhash64("node", "j", "rank").alias("a"), F.xxhash64(F.lit(1), "node", "j", "rank").alias("b"))
        release(work, placed, nodes)
        work = written(going.select("doc", "at", F.col("j").alias("below"), depth.alias("shared"), node.alias("node")), "members", inside.rows)
    release(work)
    return found


def repeated_runs(rows: DataFrame, min_chars: int = 0) -> DataFrame:
    """Maximal repeated runs with an earlier source: doc, first_line, lines, source, source_line and, if `min_chars` is
    given, chars. Runs that lie within another run aren't listed.

    `rows` has doc_id, text and the row's identity. A run has at least `min_chars` characters, line ends between its
    lines included. Earlier means a smaller (doc_id, row, line), null ids first."""
    lines = written(lines_of(rows, offsets=min_chars > 0), "lines")
    levels = suffix_levels(lines)
    history = histories(levels)
    release(*levels)
    between = copies_between(history)
    later = F.filter(F.transform("steps", lambda x, k: F.struct(F.pow(F.lit(2), k).cast("int").alias("lines"), x["first"].alias("source"))), lambda x: x["source"] != here())
    doubles = history.select("doc", "at", F.try_element_at(later, F.lit(-1)).alias("b")).filter(F.col("b").isNotNull()).select("doc", "at", "b.*")
    deepest = reduce(DataFrame.unionAll, [doubles, *between]).groupBy("doc", "at").agg(F.max_by(F.struct("lines", "source"), "lines").alias("b"))
    deepest = deepest.select("doc", F.col("at").alias("first_line"), F.col("b.lines").alias("lines"), F.col("b.source.doc").alias("source"), F.col("b.source.at").alias("source_line"))
    stop = F.col("first_line") + F.col("lines")
    before = F.max(stop).over(Window.partitionBy("doc").orderBy("first_line").rowsBetween(Window.unboundedPreceding, -1))
    runs = deepest.withColumn("before", before).filter(F.col("before").isNull() | (stop > F.col("before"))).drop("before")
    if min_chars > 0:
        runs = runs.join(lines.select("doc", F.col("at").alias("first_line"), "start"), ["doc", "first_line"]).withColumn("last", stop - 1)
        runs = runs.join(lines.select("doc", F.col("at").alias("last"), "stop"), ["doc", "last"]).withColumn("chars", F.col("stop") - F.col("start") - 1).drop("last", "start", "stop")
        runs = runs.filter(F.col("chars") >= min_chars)
    runs = written(runs, "runs", lines.rows)
    release(lines, history)
    return runs


def copied_stretches(rows: DataFrame) -> DataFrame:
    """Copies (doc, first_line, lines) whose overlaps make up the maximal repeated runs with an earlier source, as a written table.

    Every line of a run but the last begins a copy of two lines or more, so the copies at powers of two overlap from the first
    line of a run to its last, and never reach beyond it. Which lines a run takes away therefore needs no interval
    between the powers, as the length of each run by itself does (`repeated_runs`)."""
    lines = written(lines_of(rows, offsets=False), "lines")
    levels = suffix_levels(lines)
    later = [x.filter(here() != F.col("first")).select("doc", F.col("at").alias("first_line"), F.lit(1 << k).alias("lines")) for k, x in enumerate(levels)]
    longest = reduce(DataFrame.unionAll, later).groupBy("doc", "first_line").agg(F.max("lines").alias("lines"))
    found = written(longest, "stretches", levels[0].rows)
    release(lines, *levels)
    return found


def dedup_lines(docs: DataFrame, min_chars: int | None = 20) -> DataFrame:
    """All columns of `docs`, text without its later copies, with n_lines, n_removed (lines) and removed, the
    deleted stretches as (first_line, lines) in order.

    The first copy of a run stays, also within one document. Lines are compared without surrounding blanks; runs of
    fewer than `min_chars` characters stay, so short lines go only inside a longer run. Without `min_chars` every run
    goes, however short; blank lines go only where overlapping copies hold another line too. A null text stays null with
    n_lines 0; an empty text is one empty line. A document that consists of copies alone is left with an empty
    text. Repeated rows are copies like any other, null ids come first. An empty table gives an empty result. Columns
    named n_lines, n_removed or removed are replaced, one named __row is left out.
    """
    rows = numbered(docs).drop("n_lines", "n_removed", "removed")
    slim = rows.select("doc_id", "text", ROW)
    runs = copied_stretches(slim) if min_chars is None else repeated_runs(slim, min_chars)
    along = Window.partitionBy("doc").orderBy("first_line", "lines")
    joins = F.col("first_line") < F.col("reach") if min_chars is None else F.col("first_line") <= F.col("reach")
    cover = runs.select("doc", "first_line", "lines", F.max(F.col("first_line") + F.col("lines")).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("reach"))
    cover = cover.withColumn("piece", F.sum(F.when(joins, 0).otherwise(1)).over(along))
    cover = cover.groupBy("doc", "piece").agg(F.min("first_line").alias("first_line"), F.max(F.col("first_line") + F.col("lines")).alias("end"))
    gone = cover.groupBy(F.col("doc.row").alias(ROW)).agg(F.array_sort(F.collect_list(F.struct("first_line", (F.col("end") - F.col("first_line")).alias("lines")))).alias("removed"))
    joined = rows.join(gone.hint("merge"), ROW, "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<first_line:int,lines:int>>")))
    cut, zero = F.split("text", "\n", -1), F.array(F.lit(0))
    if min_chars is None:
        joined = joined.withColumn("removed", F.filter("removed", lambda r: F.exists(F.slice(cut, r["first_line"] + 1, r["lines"]), lambda line: F.trim(line) != "")))
    begins = F.concat(zero, F.transform("removed", lambda r: r["first_line"] + r["lines"]))
    ends = F.concat(F.transform("removed", lambda r: r["first_line"]), F.array(F.size(cut)))
    left = F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(cut, b + 1, e - b)))
    n_removed = F.aggregate("removed", F.lit(0), lambda total, r: total + r["lines"])
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(left, "\n")).alias("text")
    out = {c: F.col(f"`{c}`") for c in rows.columns if c != ROW}
    return joined.select(
        *[text if c == "text" else x for c, x in out.items()], F.when(F.col("text").isNull(), 0).otherwise(F.size(cut)).alias("n_lines"), n_removed.alias("n_removed"), "removed"
    )


def deduped_documents(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs, min_chars=None).select("doc_id", "text", "n_lines", "n_removed", "removed")
