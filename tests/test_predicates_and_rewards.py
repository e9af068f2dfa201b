"""Instruction predicates and rewards against values derived by hand from what each is defined to accept."""

import base64
import hashlib
import json
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import advantages as A
from millrace.functions import rewards as W
from millrace.functions import text as X
from millrace.functions import tokens as T
from millrace.operators import metrics as M
from millrace.operators import packing as P
from millrace.operators.containment import contained_items
from millrace.operators.scores import routed_rewards, token_f1_rows

#: Predicate, parameters, response, and whether it follows.
CASES = [
    ("new:copy_span_idx", {"prompt": "one two three", "start": 4, "end": 7}, " TWO\n", True),
    ("new:copy_span_idx", {"prompt": "one two three", "start": 4, "end": 6}, "two", False),
    ("paragraphs:paragraphs2", {}, "a\n\n \n\nb", False),
    ("paragraphs:paragraphs2", {}, "\n\na\n\nb\n\n", True),
    ("keywords:start_end", {}, "word", False),
    ("keywords:start_end", {}, "Word and word", True),
    ("keywords:start_end", {}, "word and word.", False),
    ("count:count_unique", {}, "The the end", True),
    ("count:count_unique", {}, "a, b, c", False),
    ("keywords:keyword_specific_position", {"keyword": "Key", "n": 1, "m": 2}, "a key b.", False),
    ("keywords:keyword_specific_position", {"keyword": "Key", "n": 2, "m": 3}, "xx. a , Key.", True),
    ("startend:quotation", {}, ' "quoted"\n', True),
    ("startend:quotation", {}, '"', False),
    ("startend:end_checker", {"phrase": "The end."}, 'So "it was the END."\n\t', True),
    ("detectable_content:postscript", {"marker": "P.P.S"}, "x\nP. P. s. more", True),
    ("detectable_content:postscript", {"marker": "P.P.S"}, "P.S. more", False),
    ("detectable_content:postscript", {"marker": "P.S."}, "p. s. more", True),
    ("detectable_content:postscript", {"marker": "Note:"}, "x NOTE: y", True),
    ("combination:repeat_prompt", {"prompt": lambda: F.lit("Say it.\n")}, "\n say IT. Yes", True),
    ("copy:copy", {"prompt": lambda: F.lit("Go\n")}, "\tgo", True),
    ("copy:repeat_phrase", {"phrase": "we go left now", "n": 3}, "we go up now, we go down now", False),
    ("copy:repeat_phrase", {"phrase": "we go left now", "n": 2}, "we go up now and we go down now", True),
    ("copy:repeat_phrase", {"phrase": "we go left now", "n": 1}, "we go left now", False),
    ("language:response_language", {"language": "de"}, "Der Hund und die Katze sind nicht mit dem Auto da", True),
    ("language:response_language", {"language": "fr"}, "The end of the story", False),
    ("language:response_language", {"language": "fr"}, "1234", True),
]


def test_predicates_by_hand(spark):
    one = spark.range(1)
    row = one.select(*[X.PREDICATES[name](F.lit(text), **{k: v() if callable(v) else v for k, v in how.items()}).alias(f"c{k}") for k, (name, how, text, _) in enumerate(CASES)]).first()
    assert [row[f"c{k}"] for k in range(len(CASES))] == [c[3] for c in CASES]


def test_multiple_choice_by_hand(spark):
    four = F.array(*map(F.lit, ["red fox", "blue", "a green tree", "none"]))
    some = [
        (W.multiple_choice_reward(F.lit("<think>Answer: A</think>The answer is B"), F.lit("B")), 1.0),
        (W.multiple_choice_reward(F.lit("The answer is B"), F.lit("C")), 0.0),
        (W.multiple_choice_reward(F.lit("It is the green tree, a green tree!"), F.lit("C"), four), 1.0),
        (W.multiple_choice_reward(F.lit("choice: a"), F.lit("Red Fox"), four), 1.0),
        (W.multiple_choice_reward(F.lit("Answer: Z. Or B"), F.lit("B"), four), 1.0),  # Z is no valid letter
        (W.multiple_choice_reward(F.lit("nothing here"), F.lit("B"), four), 0.0),
        (W.multiple_choice_reward(F.lit(None).cast("string"), F.lit("B"), four), 0.0),
        (W.multiple_choice_reward(F.lit("so it is forty two"), F.lit("x"), None, None, F.lit(None).cast("string"), F.lit("Forty-two")), 1.0),
        (W.multiple_choice_reward(F.lit("I pick (Q)"), F.lit("q"), None, F.array(F.lit("p"), F.lit("q"))), 1.0),
    ]
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(some)]).first()
    assert list(row) == [want for _, want in some]


def test_unknown_reward_types_are_errors(spark):
    df = spark.createDataFrame([("boxed_math", "so \\boxed{\\boxed{4}}", "4"), ("f1", "a cat", "the cat")], "kind string, response string, label string")
    assert [r["reward"] for r in routed_rewards(df, "kind", "response", "label").orderBy("kind").collect()] == [0.0, 1.0]
    for kind in ("poetry", None):
        with pytest.raises(PySparkException):
            routed_rewards(df.withColumn("kind", F.lit(kind).cast("string")), "kind", "response", "label").collect()


def test_long_texts_have_the_same_overlap(spark):
    df = spark.createDataFrame([(1, "the cat sat", "A cat ran!"), (2, "yes", "no"), (3, "", "x"), (4, "b b c", "b c c")], "k int, p string, g string")
    assert {r["k"]: round(r["f1"], 6) for r in token_f1_rows(df, "k", "p", "g").collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.666667}


def test_small_helpers_by_hand(spark):
    packed = base64.b64encode(zlib.compress(json.dumps([1, "é"]).encode())).decode()
    df = spark.createDataFrame([(1, "name", packed), (2, None, "[2]"), (3, "x", "not json")], "k int, n string, j string")
    rows = {r["k"]: r for r in df.select("k", W.stable_seed(F.col("n"), 5).alias("s"), W.decoded_json(F.col("j")).alias("j"), W.compression(F.repeat(F.col("n"), F.lit(100)))["ratio"].alias("c")).collect()}
    assert rows[1]["s"] == int.from_bytes(hashlib.blake2b(b"5:name", digest_size=8).digest(), "little") & 0x7FFFFFFF and rows[2]["s"] is None
    assert json.loads(rows[1]["j"]) == [1, "é"] and rows[2]["j"] == "[2]" and rows[3]["j"] is None
    assert abs(rows[1]["c"] - 400 / len(zlib.compress(b"name" * 100, 9))) < 1e-9
    kw = spark.range(1).select(W.coerced_kwargs(F.array(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"))), F.lit(3)).alias("m")).first()["m"]
    assert kw == [{"a": "1"}] * 3


def test_long_answers_cost_in_proportion(spark):
    """Discounted sums equal a plain loop, beyond one chunk, and 40,000 tokens are no matter of minutes."""
    import random
    import time

    rng = random.Random(4)
    for n in (0, 1, 127, 128, 129, 1000):
        r = [rng.random() for _ in range(n)]
        got = spark.createDataFrame([(r,)], "r array<double>").select(T.discounted(F.col("r"), 0.97).alias("d")).first()["d"]
        want, acc = [], 0.0
        for x in reversed(r):
            acc = x + 0.97 * acc
            want.append(acc)
        assert len(got) == n and all(abs(a - b) < 1e-9 for a, b in zip(got, reversed(want)))
    start = time.time()
    spark.range(4).select(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: i / 7.0).alias("r")).select(F.aggregate(T.discounted(F.col("r"), 0.99), F.lit(0.0), lambda a, x: a + x)).collect()
    assert time.time() - start < 30


def test_estimators_and_their_errors(spark):
    a = lambda *xs: F.array(*[F.lit(x) for x in xs])
    kl, mask, values = a(0.1, 0.2, 0.3), a(1.0, 1.0, 0.0), a(0.5, 0.5, 0.5)
    ppo, returns = A.advantages("ppo", F.lit(1.0), kl, mask, values, beta=1.0)
    row = spark.range(1).select(A.advantages("gspo", F.lit(2.0), kl, mask)[0].alias("g"), A.advantages("reinforce_plus_plus", F.lit(1.0), kl, mask, beta=1.0)[0].alias("r"), ppo.alias("p"), returns.alias("q")).first()
    assert row["g"] == [2.0] * 3 and [round(x, 9) for x in row["r"]] == [0.7, 0.8, 0.0]
    assert [round(x, 9) for x in row["p"]] == [-0.1, 0.0, 0.2] and [round(x, 9) for x in row["q"]] == [0.4, 0.5, 0.7]
    with pytest.raises(ValueError):
        A.advantages("best", F.lit(1.0), kl, mask)
    with pytest.raises(ValueError):
        T.policy_loss(kl, values, 0.2, 0.2, dual=1.0)
    far = spark.createDataFrame([([1e9 + 1, 1e9 + 2, 1e9 + 3], [1.0, 1.0, 1.0])], "x array<double>, m array<double>")
    assert [round(v, 6) for v in A.whitened(far, "x", "m").first()["x"]] == [-1.0, 0.0, 1.0]


def test_packing_modes(spark):
    rows = [(0, i, n) for i, n in enumerate([9, 9, 4, 4, 4, 4, 1, 1, 8, 8, 2, 2])]
    df = spark.createDataFrame(rows, "step int, k int, n int")
    for mode, bins in (("dynamic", 6), ("balanced", 6), ("fixed", 4)):
        got = P.packed_steps(df, "step", "k", "n", 2, 10, mode=mode, size=3).collect()
        by = {b: sum(rows[r["k"]][2] for r in got if r["micro_batch"] == b) for b in {r["micro_batch"] for r in got}}
        assert len(by) == bins and len(got) == 12
        if mode == "balanced":
            assert max(by.values()) <= 10
        ranks = [len({r["micro_batch"] for r in got if r["rank"] == k}) for k in (0, 1)]
        assert sum(ranks) == bins and abs(ranks[0] - ranks[1]) <= 1
    sent = P.per_rank(P.packed_steps(df, "step", "k", "n", 2, 10), df, ["step", "k"]).collect()
    assert sorted(x for r in sent for x in r["n"]) == sorted(n for _, _, n in rows)
    assert P.chunked([3, 4, 5, 1, 9], 10) == [[0, 1], [2, 3], [4]]
    with pytest.raises(ValueError):
        P.balanced([1], 2)


def test_contained_items_of_any_number_and_length(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "xyz"), (3, "ab cd ef gh")], "doc_id int, text string")
    items = [(i, f"zq{i}") for i in range(1500)] + [(2000, "wo three fo"), (2001, "xy"), (2002, "two three four five six seven eight ni"), (2003, "d e"), (2004, "b cd ef g"), (2005, "cd xx ef")]
    got = {(r["doc_id"], r["item_id"]) for r in contained_items(docs, spark.createDataFrame(items, "item_id int, text string")).collect()}
    assert got == {(1, 2000), (2, 2001), (1, 2002), (3, 2003), (3, 2004)}


def test_decisions_by_hand(spark):
    runs = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.0), (2, 0, 0.01), (2, 1, 0.02), (3, 0, 0.0)], "cap int, seed int, t double")
    assert M.smallest_cap(runs, "cap", "seed", "t", [0, 1], 0.02).first()["selected"] == 2
    gains = spark.createDataFrame([("a", 0.01, -0.1), ("a", 0.02, 0.0), ("b", 0.01, 0.1)], "k string, gain double, low double")
    assert {r["k"]: r["decision"] for r in M.budget_decision(gains, ["k"], "gain", "low", 0.05).collect()} == {"a": "keep", "b": "double"}
    evals = spark.createDataFrame([("a", "eval", 9, 1), ("a", "final", 5, 2), ("a", "final", 4, 3), ("b", "eval", 3, 4), ("b", "eval", 2, 5)], "run string, phase string, u int, k int")
    assert sorted(r["k"] for r in M.final_evaluation(evals, "run", "phase", "u").collect()) == [2, 4]
    manifest = spark.createDataFrame([("x", "math"), ("y", "code"), ("z", "code")], "name string, task string")
    assert M.single_source(manifest, "math").first()["name"] == "x"
    for task in ("code", "none"):
        with pytest.raises(ValueError):
            M.single_source(manifest, task)
    with pytest.raises(ValueError):
        M.contiguous_pass_rates(spark.range(7).withColumn("r", F.lit(1.0)), "id", "r", 2, [1])
