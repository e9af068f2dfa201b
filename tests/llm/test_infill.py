"""Fill-in-middle examples against a plain version, and whole round trips."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import infill

TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "one line\n", "a\nb\nc", "a\nb\nc\n", "\na\n\nb", "é\n\U0001f600 x\nz", "\x1e\n\x1b\n\x1e1\x1b0\n\x1b1", "a\x1b0\x1e\nb", "ends in <\n<S\n<M", "x<P>y\nz", "x<S>", "<M>",
    "\r\nb\r\n", "$1\n\\1\n$", "\x00\n\x00", "a" * 50000 + "\n" + "b\n" * 3000,
]


def expected(doc_id, text, rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in infill.MARKERS) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm_rate else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("rate", "spm_rate"), [(100, 50), (60, 0), (100, 100)])
def test_infill_equals_plain_version(spark, rate, spm_rate):
    rows = [(k, t) for k, t in enumerate(TEXTS * 6)] + [(None, "a\nb"), (None, "a\nb"), (-5, "a\nb\nc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("form", F.lit("clash")).withColumn("n", F.lit(1))
    out = infill.infilled(docs, rate, spm_rate).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows)
    found = sorted(((r.doc_id is None, r.doc_id or 0), r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output) for r in out)
    assert found == sorted(((k is None, k or 0), *expected(k, t, rate, spm_rate)) for k, t in rows)
    texts = {}
    for k, t in rows:
        texts[k] = t or ""
    assert all(r.back == texts[r.doc_id] for r in out)
    assert {r.form for r in out} == {"plain"} | ({"spm"} if spm_rate else set()) | ({"psm"} if spm_rate < 100 else set())


def test_infill_digests_and_empty_table(spark):
    docs = spark.createDataFrame([(3, "a\nb\nc"), (4, None)], "doc_id int, text string")
    for r in infill.infilled_documents(docs).collect():
        n, form, p, m, output = expected(r.doc_id, "a\nb\nc" if r.doc_id == 3 else None)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(("a\nb\nc" if r.doc_id == 3 else "").encode()).hexdigest()
    assert infill.infilled_documents(docs.limit(0)).count() == 0
    plan = infill.infilled_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Exchange|Pandas|Arrow", plan)
