"""Spans of traces, paired and clipped; the expected values were worked out by hand."""

import random

from millrace.operators.spans import clipped_spans

EVENTS = "trace string, pos int, kind string, span string, parent string, name string, time double"


def clipped(spark, events, trace="t"):
    rows = [(trace, k, *e) for k, e in enumerate(events)]
    out = clipped_spans(spark.createDataFrame(rows, EVENTS)).collect()
    return sorted((r.span or "", r.state, r.display_stop, r.clipped_by) for r in out)


def start(span, time, parent=None):
    return ("span_start", span, parent, span, float(time))


def end(span, time):
    return ("span_end", span, None, span, float(time))


def point(time):
    return ("event", None, None, "p", float(time))


def test_clipped_by_row_end_sibling_and_ancestor(spark):
    events = [start("root", 0), start("a", 1, "root"), start("b", 4, "root"), end("b", 6), start("c", 5, "a"), end("root", 8), start("late", 7, "b"), point(10)]
    assert clipped(spark, events) == [
        ("a", "open", 4.0, "next_sibling_start"),
        ("b", "closed", 6.0, None),
        ("c", "open", 8.0, "ancestor_end"),  # a is open, so the root's end counts
        ("late", "open", 10.0, "row_end"),  # b ended before it began
        ("root", "closed", 8.0, None),
    ]


def test_ties_missing_parents_and_cycles(spark):
    events = [start("x", 1, "y"), start("y", 2, "x"), start("z", 9, "nobody"), start("same", 3, "q"), start("twin", 3, "q"), point(9)]
    assert clipped(spark, events) == [
        ("same", "open", 9.0, "row_end"),  # a sibling that starts together doesn't count
        ("twin", "open", 9.0, "row_end"),
        ("x", "open", 9.0, "row_end"),
        ("y", "open", 9.0, "row_end"),
        ("z", "open", 9.0, "self"),
    ]
    equal = [start("p", 0), start("o", 1, "p"), start("o2", 5, "p"), end("p", 5), end("o2", 5)]
    assert ("o", "open", 5.0, "row_end") in clipped(spark, equal)


def test_repeated_starts_and_ends(spark):
    events = [end("a", 0), start("a", 1), start("a", 2), end("a", 3), end("a", 4), end(None, 5), start("a", 6), point(7)]
    assert clipped(spark, events) == [("", "orphan", None, None), ("a", "closed", 3.0, None), ("a", "open", 7.0, "row_end"), ("a", "orphan", None, None), ("a", "orphan", None, None)]


def walked(events):
    """The same, one trace after the other in plain steps; spans are distinct."""
    spans, last = {}, max(e[4] for e in events)
    for kind, span, parent, _, time in events:
        if kind == "span_start":
            spans[span] = [parent, time, None]
        elif kind == "span_end" and span in spans and spans[span][2] is None:
            spans[span][2] = time
    out = []
    for s, (parent, begun, stop) in spans.items():
        if stop is not None:
            out.append((s, "closed", stop, None))
            continue
        options = [(last, 0, "row_end")]
        later = [t for o, (p, t, _) in spans.items() if p == parent and t > begun]
        if later:
            options.append((min(later), 1, "next_sibling_start"))
        up, seen = parent, set()
        while up in spans and up not in seen and spans[up][2] is None:
            seen.add(up)
            up = spans[up][0]
        if up in spans and spans[up][2] is not None and spans[up][2] > begun:
            options.append((spans[up][2], 2, "ancestor_end"))
        at, _, by = min(options)
        out.append((s, "open", at, by) if at > begun else (s, "open", begun, "self"))
    return sorted(out)


def test_random_traces_equal_plain_steps(spark):
    rng, rows, want = random.Random(3), [], []
    for trace in range(40):
        events, names = [], [f"s{k}" for k in range(30)]
        for k, s in enumerate(names):
            events.append(start(s, rng.randint(0, 40), rng.choice([None, "gone", *names[max(0, k - 6) : k + 3]])))
            if rng.random() < 0.5:
                events.append(end(rng.choice(names[: k + 1]), rng.randint(0, 60)))
        rows += [(str(trace), k, *e) for k, e in enumerate(events)]
        want += [(str(trace), *x) for x in walked(events)]
    out = clipped_spans(spark.createDataFrame(rows, EVENTS)).filter("state <> 'orphan'").collect()
    assert sorted((r.trace, r.span, r.state, r.display_stop, r.clipped_by) for r in out) == sorted(want)
