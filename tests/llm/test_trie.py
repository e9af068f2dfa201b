"""The prefix trie against a plain version, with families, copies, ties, gaps and long conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from millrace.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id bigint, turn bigint, role string, text string"


def expected(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role[:64], text[:64], hashlib.md5(f"{role}\0{text}".encode()).hexdigest(), role, text))
    own = {c: [x[-2:] for x in sorted(t)] for c, t in convs.items()}
    root = {"members": [], "ends": [], "kids": {}, "bytes": 0, "depth": 0}
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(c % 5 if c >= 0 else -(-c % 5))
        at = root
        at["members"].append(c)
        for turn in own.get(base, [])[:h] + own[c][h:]:
            at = at["kids"].setdefault(turn, {"members": [], "ends": [], "kids": {}, "bytes": len(turn[1].encode()), "depth": at["depth"] + 1})
            at["members"].append(c)
        at["ends"].append(c)
    # Sums from the deepest nodes up; no recursion, since paths are long.
    order, todo = [], [(root, None)]
    while todo:
        node, parent = todo.pop()
        order.append((node, parent))
        todo += [(k, node) for k in node["kids"].values()]
    out = []
    for node, parent in reversed(order):
        node["leaves"] = sum(k["leaves"] for k in node["kids"].values()) if node["kids"] else 1
        node["saved"] = (len(node["members"]) - 1) * node["bytes"] + sum(k["saved"] for k in node["kids"].values())
        digest = hashlib.sha256(",".join(map(str, node["ends"])).encode()).hexdigest()
        out.append((node["members"][0], node["depth"], parent["members"][0] if parent else None, len(node["members"]), len(node["kids"]), node["leaves"], node["saved"], digest))
    return sorted(out, key=str) if own else []


def found(spark, rows, schema=TURNS):
    out = trie.prefix_trie(spark.createDataFrame(rows, schema))
    assert out.columns == COLUMNS and {t for c, t in out.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted(map(tuple, out.collect()), key=str)


def random_turns(rng, ids, most, words):
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for c in ids for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_plain_version(spark, seed):
    rng = random.Random(seed)
    rows = random_turns(rng, rng.sample(range(-30, 60), 60), 14, ["a", "b", None, "é\U0001f600"])
    rows += [(c, t, r, x) for c, t, r, x in random_turns(rng, [300], 12, ["a", "b"]) for c in (300, 300 + 5 * seed, 1000, 1007)]  # copies
    rows += [(61, None, "user", "x"), (61, None, "user", "a"), (61, None, None, None), (61, 1, "user", "x"), (61, 1, "user", "x"), (None, 0, "user", "x")]
    rng.shuffle(rows)
    assert found(spark, rows) == expected(rows)


def test_trie_of_long_conversations(spark, monkeypatch):
    """Slices far smaller than the conversations, which share long beginnings with each other."""
    monkeypatch.setattr(trie, "SLICE", 16)
    rng = random.Random(5)
    script = [rng.choice("abcd") for _ in range(150)]
    rows = [(c, t, "user", x) for c, n in ((0, 150), (1, 150), (3, 90), (25, 150), (26, 16), (27, 17), (28, 33), (40, 120), (70, 16)) for t, x in enumerate(script[:n])]
    rows += [(c, t, "user", rng.choice("ab")) for c in (1, 40) for t in range(150, 190)] + random_turns(rng, range(80, 100), 20, ["a", "b"])
    assert found(spark, rows) == expected(rows)


def test_trie_of_many_copies_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 3)
    rows = [(c, t, "user", f"t{t}") for c in range(-20, 120) for t in range(3)] + [(c, 0, "user", "other") for c in range(200, 260, 5)]
    assert found(spark, rows) == expected(rows)


def test_trie_of_odd_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "a", "b")]) == []
    assert found(spark, [(7, None, None, None)]) == expected([(7, None, None, None)])
    clashing = spark.createDataFrame([(5, 0, "u", "x" * 200_000, 1, 2), (6, 0, "u", "x" * 200_000, 3, 4)], TURNS + ", depth int, conv int")
    assert sorted(map(tuple, trie.prefix_trie(clashing).collect()), key=str) == expected([(5, 0, "u", "x" * 200_000), (6, 0, "u", "x" * 200_000)])
