"""What the driver holds of the pipeline's inputs."""

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import language as L


def test_drawn_vectors_reach_the_driver_compressed(spark, sf, monkeypatch):
    """They took over 100 MB of its memory, since its JVM and its Python hold all of them several times over."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 2000").limit(300).localCheckpoint()
    frame, sent = type(docs), []
    real = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: sent.append(real(self)) or sent[-1])
    model = L.fit(docs, per_language=1000)
    monkeypatch.undo()
    got = [r["f"] for rows in sent for r in rows if "f" in r.asDict()]
    assert len(got) > 50 and sum(map(len, got)) < len(got) * (4 << L.BITS) / 4
    # The model is the one of the same vectors in their own order, to the last bit.
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~L.held_out(F.col("doc_id"))).select("lang", "text", "doc_id").distinct().collect()
    rows = sorted((r["lang"], L.features(r["text"]).astype("<f4").tobytes()) for r in known)
    want = L.LanguageModel(np.array([np.frombuffer(f, dtype="<f4") for _, f in rows]), np.array([lang for lang, _ in rows], dtype=object))
    assert len(got) == len(rows) and model.families == want.families
    for a, b in zip([model.outer, *model.inner.values()], [want.outer, *want.inner.values()], strict=True):
        assert a.names == b.names and all(np.array_equal(v, w) for v, w in zip(a.w, b.w, strict=True))
