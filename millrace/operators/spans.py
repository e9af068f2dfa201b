"""Spans of traces: pairing starts and ends, and where spans that never ended are drawn to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut


def spans_of_events(events: DataFrame) -> DataFrame:
    """(trace, span, parent, name, start, stop, closed_at, state) of events (trace, pos, kind, span, parent, name, time).

    Events are read in the order of `pos`. An end closes the start before it with the same span; without one it is an orphan. A
    start that is followed by another start of its span is forgotten, and one that nothing follows is open. Events of other
    kinds, and starts without a span, are points and no spans."""
    same = Window.partitionBy("trace", "span").orderBy("pos")
    ends = [F.lead(c).over(same).alias(f"next_{c}") for c in ("kind", "time", "pos")]
    paired = events.filter(F.col("kind").isin("span_start", "span_end") & (F.col("span").isNotNull() | (F.col("kind") == "span_end")))
    paired = paired.select("trace", "pos", "kind", "span", "parent", "name", "time", F.lag("kind").over(same).alias("before"), *ends)
    start, end, next_end = F.col("kind") == "span_start", F.col("kind") == "span_end", F.col("next_kind") == "span_end"
    orphan = end & (F.col("span").isNull() | ~F.coalesce(F.col("before") == "span_start", F.lit(False)))
    state = F.when(orphan, "orphan").when(start & next_end, "closed").when(start & F.col("next_kind").isNull(), "open")
    found = paired.select("trace", "span", "parent", "name", F.when(start, F.col("time")).alias("start"), F.when(end, F.col("time")).otherwise(F.when(next_end, F.col("next_time"))).alias("stop"), F.when(next_end, F.col("next_pos")).alias("closed_at"), state.alias("state"))
    return found.filter("state IS NOT NULL")


def closed_ancestor_ends(spans: DataFrame) -> DataFrame:
    """(trace, span, ancestor_stop): the end of the nearest ancestor that has one, for each open span of `spans_of_events` that has such.

    Pointers that lead through open ancestors are doubled, so a path of n open spans takes log n joins of the open spans alone. A
    missing parent ends a path, and so does a cycle of open spans, which never comes to an end. Where a span's name stands
    for several spans, the open one counts, else the one that was closed last."""
    known = spans.filter("state <> 'orphan'").groupBy("trace", "span").agg(F.max_by(F.struct("parent", "stop"), F.struct((F.col("state") == "open").alias("open"), "closed_at")).alias("s"))
    known = known.select("trace", F.col("span").alias("parent"), F.col("s.parent").alias("above"), F.col("s.stop").alias("up_stop"))
    open_spans = spans.filter("state = 'open'").select("trace", "span", "parent")
    # to: an open ancestor whose own path goes on; stop: what was found. Neither: the path has ended.
    at = open_spans.join(known, ["trace", "parent"]).select("trace", "span", F.when(F.col("up_stop").isNull(), F.col("parent")).alias("to"), F.col("up_stop").alias("ancestor_stop"))
    at = cut(at)
    for _ in range(at.count().bit_length() + 1):
        if at.filter("to IS NOT NULL").isEmpty():
            break
        up = at.select("trace", F.col("span").alias("to"), F.col("to").alias("then"), F.col("ancestor_stop").alias("found"))
        at = cut(at.join(up, ["trace", "to"], "left").select("trace", "span", F.col("then").alias("to"), F.coalesce("ancestor_stop", "found").alias("ancestor_stop")))
    return at.filter("ancestor_stop IS NOT NULL").select("trace", "span", "ancestor_stop")


def next_starts(spans: DataFrame) -> DataFrame:
    """(trace, parent, start, next_start): for each start, the first later one with the same parent; no parent is one too."""
    starts = spans.filter("state <> 'orphan'").select("trace", "parent", "start").distinct()
    return starts.withColumn("next_start", F.lead("start").over(Window.partitionBy("trace", "parent").orderBy("start")))


def clipped_spans(events: DataFrame) -> DataFrame:
    """The spans of `spans_of_events` with display_stop and clipped_by (null unless open).

    An open span is drawn up to the last time of its trace (row_end), the next start among its siblings (next_sibling_start),
    or the end of its nearest closed ancestor (ancestor_end), if that is later than its start: the earliest of these, of equal
    ones the first named. Where that isn't after its start, it has no length (self). Orphans have no display_stop."""
    spans = cut(spans_of_events(events))
    ends = events.groupBy("trace").agg(F.max("time").alias("row_end"))
    later = next_starts(spans).select("trace", F.col("parent").alias("__parent"), F.col("start").alias("__start"), "next_start")
    opened = spans.filter("state = 'open'").join(ends, "trace").join(closed_ancestor_ends(spans), ["trace", "span"], "left")
    siblings = (opened["trace"] == later["trace"]) & opened["parent"].eqNullSafe(later["__parent"]) & (opened["start"] == later["__start"])
    opened = opened.join(later, siblings, "left").drop(later["trace"]).drop("__parent", "__start")

    def candidate(at: Column, order: int, by: str) -> Column:
        return F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(order).alias("order"), F.lit(by).alias("by")))

    after = F.when(F.col("ancestor_stop") > F.col("start"), F.col("ancestor_stop"))
    best = F.least(candidate(F.col("row_end"), 0, "row_end"), candidate(F.col("next_start"), 1, "next_sibling_start"), candidate(after, 2, "ancestor_end"))
    inside = best["at"] > F.col("start")
    opened = opened.select(*spans.columns, F.when(inside, best["at"]).otherwise(F.col("start")).alias("display_stop"), F.when(inside, best["by"]).otherwise("self").alias("clipped_by"))
    rest = spans.filter("state <> 'open'").select("*", F.when(F.col("state") == "closed", F.col("stop")).alias("display_stop"), F.lit(None).cast("string").alias("clipped_by"))
    return opened.unionByName(rest)
