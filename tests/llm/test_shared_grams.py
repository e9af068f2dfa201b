"""Q-grams that many items share are counted piece by piece, with the same counts and answers, in bounded memory."""

import random
import tracemalloc

import numpy as np

from millrace.llm import decontaminate as D


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def hits(index, c):
    g = D.grams(c)
    lo, hi = np.searchsorted(index.codes, g, side="left"), np.searchsorted(index.codes, g, side="right")
    return np.arange(len(g)), lo, hi - lo


def test_pieces_add_up_to_the_whole():
    rng = random.Random(3)
    shared = words(rng, 12)
    index = D.Index([(k, f"{shared} {words(rng, 25)}") for k in range(30)], 100, 0.06)
    text, _ = D.Letters()(" ".join([shared, words(rng, 30), shared, words(rng, 5)] * 3))
    i, lo, n = hits(index, text)
    want = dict(zip(*(x.tolist() for x in index.counted(i, lo, n, 14)), strict=True))
    # Each hit by itself, in both of its bands.
    plain = {}
    for p, a, m in zip(i.tolist(), lo.tolist(), n.tolist(), strict=True):
        for at in range(a, a + m):
            d = p - int(index.offset[at])
            for band in (d // 14 * 2, (d - 7) // 14 * 2 + 1):
                key = int(index.owner[at]) * (1 << 32) + band + (1 << 30)
                plain[key] = plain.get(key, 0) + 1
    assert want == plain
    for most in (1, 7, 100, 5000):
        assert dict(zip(*(x.tolist() for x in index.counted(i, lo, n, 14, most)), strict=True)) == plain
    none = index.counted(i[:0], lo[:0], n[:0], 14)
    assert len(none[0]) == 0


def test_one_sentence_in_all_items_and_over_and_over_in_a_text():
    rng = random.Random(1)
    sentence = "choose the best answer to the following question and explain every step of your reasoning before you give one letter. "
    index = D.Index([(k, sentence + words(rng, 12)) for k in range(1000)], 100, 0.06)
    text, _ = D.Letters()(sentence * 200)
    tracemalloc.start()
    found = index.find(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1000 and all(v[0] < 130 and v[2] == 0 for v in found.values())
    assert peak < 300e6
