"""Buckets of near-dedup whose members are alike, but mostly under the similarity that links them."""

import random

import numpy as np
import pytest

from millrace.llm import similar


def alike(rng, members):
    """Texts of 200 words around a centre, of which each lacks three or four."""
    words = ["".join(rng.choices("abcd", k=6)) for _ in range(200)]
    return [" ".join(f"z{rng.random()}" if k in gone else w for k, w in enumerate(words)) for gone in (set(rng.sample(range(200), rng.choice([3, 4]))) for _ in range(members))]


def smallest(texts, least=0.8):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if root[i] != root[j] and len(x & y) >= least * len(x | y):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return set(root)


@pytest.mark.parametrize("rows", [1024, 40])
def test_a_bucket_is_compared_whole_without_a_row_for_each_pair(spark, monkeypatch, rows):
    if rows != 1024:  # large buckets: single members first, then blocks
        monkeypatch.setattr(similar, "BLOCK_ROWS", rows)
    given, pairs_of = [], similar.similar_pairs
    monkeypatch.setattr(similar, "similar_pairs", lambda pairs, *a: given.append(pairs.count()) or pairs_of(pairs, *a))
    rng = random.Random(5)
    texts = alike(rng, 120) + alike(rng, 60)
    kept = {r["doc_id"] for r in similar.without_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert kept == smallest(texts) and 20 < len(kept) < 178
    assert sum(given) < 12 * len(texts)


def test_shared_counts_equal_sets():
    rng = np.random.default_rng(2)
    for m in (1, 2, 7, 70, 200):
        sets = [np.unique(np.concatenate([rng.integers(0, 40, 8), rng.integers(100, 3000, rng.integers(1, 90))])).astype(np.int64) for _ in range(m)]
        same = similar.shared_counts(sets, columns=32, most=300)
        wanted = np.array([[len(set(x.tolist()) & set(y.tolist())) for y in sets] for x in sets])
        assert (np.triu(same, 1) == np.triu(wanted, 1)).all() and (np.tril(same, -1) == np.tril(wanted, -1)).all()
