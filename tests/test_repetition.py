"""The flag of repetitive texts against zlib itself, over whole texts."""

import zlib

from millrace import plans


def flag(text):
    tail = text[-10_000:]
    return len(text) > 10_000 and len(tail.encode()) / len(zlib.compress(tail.encode(), 9)) > 10


def test_flags_of_all_documents(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.once, r.thrice) for r in plans.QUERIES["pf20_repetitive"](spark, sf).collect()}
    assert got == {k: (flag(t), flag(t * 3)) for k, t in texts.items()}
    assert any(b for _, b in got.values())
