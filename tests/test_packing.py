"""Schedules of training steps: hand-derived plans, and random ones against a plain version."""

import itertools
import random
from collections import defaultdict

import pytest

from millrace.operators import packing as P


def plain_differencing(lengths, k, equal_size):
    """The same method over plain lists, always looking for the two states that go first."""
    items = sorted((n, i) for i, n in enumerate(lengths))
    states = []
    for at in range(0, len(items), k if equal_size else 1):
        some = items[at : at + (k if equal_size else 1)]
        states.append([[(i, n)] for n, i in some] + [[] for _ in range(k - len(some))])
    rank = lambda part: (sum(n for _, n in part), len(part), part)
    for s in states:
        s.sort(key=rank, reverse=True)
    while len(states) > 1:
        states.sort(key=lambda s: (rank(s[0])[0] - rank(s[-1])[0], rank(s[0])))
        one, two = states.pop(), states.pop()
        states.append(sorted((p + q for p, q in zip(one, two[::-1])), key=rank, reverse=True))
    return [[i for i, _ in p] for p in states[0]]


@pytest.mark.parametrize("equal_size", [False, True])
def test_differencing_equals_plain_version(equal_size):
    rng = random.Random(int(equal_size))
    for _ in range(150):
        k = rng.randint(1, 5)
        n = rng.randint(1, 4) * k if equal_size else rng.randint(1, 16)
        lengths = [rng.choice([rng.randint(0, 9), rng.randint(1, 3)]) for _ in range(n)]
        parts = P.differencing(lengths, k, equal_size)
        assert parts == plain_differencing(lengths, k, equal_size)
        assert sorted(i for p in parts for i in p) == list(range(n))
        if equal_size:
            assert {len(p) for p in parts} == {n // k}


def test_spread_near_the_best():
    """On small steps the two parts lie apart by the best possible for nearly all, and never by over the shortest item more."""
    rng, best = random.Random(4), 0
    for _ in range(100):
        lengths = [rng.randint(1, 30) for _ in range(8)]
        total = sum(lengths)
        least = min(abs(total - 2 * sum(c)) for r in range(1, 5) for c in itertools.combinations(lengths, r))
        got = abs(total - 2 * sum(lengths[i] for i in P.balanced(lengths, 2)[0]))
        assert least <= got <= least + max(lengths)
        best += got == least
    assert best > 40


def test_by_hand():
    # 8 and 7 leave 1, 6 and 5 leave 1, these and 4: the widest spread is 4's, which meets one of them first.
    assert [sum([8, 7, 6, 5, 4][i] for i in p) for p in P.differencing([8, 7, 6, 5, 4], 2)] == [16, 14]
    assert P.differencing([1, 2, 3, 4], 2, equal_size=True) in ([[3, 0], [1, 2]], [[0, 3], [1, 2]], [[2, 1], [0, 3]], [[1, 2], [0, 3]], [[3, 0], [2, 1]])
    assert P.split_bin([0, 1, 2, 3], [5, 9, 5, 1]) == ([1, 3], [0, 2])  # 9 | 5, 5 | then 1 goes to 9
    assert P.expanded([[0, 1], [2, 3]], 3, [4, 4, 4, 4]) == [[0, 1], [2], [3]]  # of equal bins the last
    assert P.expanded([[0], [1]], 5, [3, 3]) == [[0], [1]]
    with pytest.raises(ValueError, match="can't make"):
        P.differencing([1, 2, 3], 2, equal_size=True)
    with pytest.raises(ValueError, match="fewer than 2 parts"):
        P.balanced([1], 2)
    assert P.differencing([0, 5], 3) == [[1], [0], []]


def plan(lengths, ranks, most=None, mode="dynamic", size=2, group=1, even=False, weights=None):
    out = P.step_plan(lengths, weights or lengths, ranks, most, mode, size, group, even)
    bins, places = defaultdict(list), defaultdict(list)
    for i, (b, r, place) in enumerate(out):
        bins[b].append(i)
        places[r].append(place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) == set(range(ranks))
    per_rank = {r: len({b for b, q, _ in out if q == r}) for r in range(ranks)}
    assert len(set(per_rank.values())) == 1 and per_rank[0] % group == 0
    return out, dict(bins), per_rank[0]


def test_fixed_size_in_turn_and_balanced():
    out, bins, each = plan([10] * 16, 4, mode="fixed", size=2)
    assert each == 2 and bins[0] == [0, 1] and [r for _, r, _ in out[:8:2]] == [0, 1, 2, 3]
    out, bins, each = plan([1, 2, 3, 4, 5, 6, 7, 8], 2, mode="fixed", size=2, even=True)
    assert each == 2 and [sum(n for n, (_, q, _) in zip(range(1, 9), out) if q == r) for r in (0, 1)] == [18, 18]
    with pytest.raises(ValueError, match="16 samples in 6 micro-batches, 8 are needed"):
        plan([10] * 16, 4, mode="fixed", size=3)


def test_weights_deal_ranks():
    """Operations grow with the square of the length: the longest sample outweighs what tokens alone would give it."""
    lengths = [1, 2, 3, 4, 5, 7, 9, 10]
    out, _, each = plan(lengths, 2, mode="fixed", size=1, even=True, weights=[n * n for n in lengths])
    work = [sum(n * n for n, (_, q, _) in zip(lengths, out) if q == r) for r in (0, 1)]
    assert each == 4 and abs(work[0] - work[1]) <= 5


def test_dynamic_bins_and_oversize():
    out, bins, _ = plan([15, 3, 3, 3, 3, 3, 3, 3], 2, most=10)
    assert [b for b in bins.values() if 0 in b] == [[0]]
    assert all(sum([15, 3, 3, 3, 3, 3, 3, 3][i] for i in b) <= 10 for b in bins.values() if 0 not in b)
    _, bins, each = plan([4] * 16, 2, most=8, group=2)
    assert each % 2 == 0 and all(len(b) <= 2 for b in bins.values())
    with pytest.raises(ValueError, match="3 samples in 3 micro-batches, 4 are needed"):
        plan([4] * 3, 2, most=8, group=2)
    with pytest.raises(ValueError, match="1 samples are fewer than 2 ranks"):
        plan([4], 2, most=8)


def test_balanced_bins_follow_the_tokens():
    """30 tokens fill three bins of 12, which differencing evens by weight and alignment makes four."""
    _, bins, each = plan([5, 5, 5, 5, 5, 5], 2, most=12, mode="balanced", even=True)
    assert len(bins) == 4 and each == 2
    _, bins, _ = plan([9, 9, 9], 3, most=9, mode="balanced")
    assert sorted(bins.values()) == [[0], [1], [2]]


def test_schedule_keeps_rollouts_together_and_drops_the_rest(spark):
    def schedule(rollouts, each, most=12, ranks=1, **how):
        rows = [(r, k, 3) for k, r in enumerate(rollouts)]
        return P.training_schedule(spark.createDataFrame(rows, "rollout int, pos int, n int"), "rollout", "pos", "n", each, ranks, most, **how).collect()

    by_step = defaultdict(list)
    for r in schedule([0, 0, 0, 1, 1, 2, 2, 2, 2], 1):
        by_step[r.step].append(r.pos)
    assert {s: sorted(p) for s, p in by_step.items()} == {0: [0, 1, 2], 1: [3, 4], 2: [5, 6, 7, 8]}
    assert sorted(r.pos for r in schedule([0, 0, 1, 2, 2, 3, 4, 4], 2)) == [0, 1, 2, 3, 4, 5]
    mixed = schedule([7, 3, 7, 3, 5, 5], 2)  # samples of a step stand rollout by rollout, as they first came
    assert sorted((r.place, r.pos) for r in mixed) == [(0, 0), (1, 2), (2, 1), (3, 3)]
    with pytest.raises(ValueError, match="fewer rollouts"):
        schedule([0, 1], 3)
    with pytest.raises(Exception, match="fewer than 8 ranks"):
        schedule([0, 1], 2, ranks=8)
