"""Overlapping copies at powers of two make up the same stretches as all maximal repeated runs."""

import random

from millrace.llm import lines
from millrace.llm.common import ROW, numbered


def stretches(rows, length):
    """(document, first line, end) of runs that overlap, joined."""
    out = []
    for doc, first, n in sorted((str(r["doc"]), r["first_line"], r[length]) for r in rows):
        if out and out[-1][0] == doc and first < out[-1][2]:
            out[-1][2] = max(out[-1][2], first + n)
        else:
            out.append([doc, first, first + n])
    return out


def test_stretches_equal_those_of_maximal_runs(spark):
    rng = random.Random(12)
    rows = []
    for k in range(40):
        script = rng.choices(["a", "b", "", "c", f"own {k}"], k=rng.randint(0, 25))
        if rows and rng.random() < 0.6:  # a stretch of an earlier document
            other = rng.choice(rows)[1].split("\n")
            at = rng.randrange(len(other))
            script[rng.randint(0, len(script)) :] = other[at : at + rng.randint(1, 12)]
        rows.append((k, "\n".join(script)))
    docs = numbered(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "text", ROW).cache()
    assert stretches(lines.copied_stretches(docs).collect(), "lines") == stretches(lines.repeated_runs(docs).collect(), "lines")
