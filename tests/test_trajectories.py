"""Masks and sessions by hand."""

from pyspark.sql import functions as F

from millrace.functions import chat_masks as C
from millrace.operators import trajectories as J


def turn(prompt, response, ids, out, finish="stop"):
    return {"prompt": [{"role": r, "content": c} for r, c in prompt], "response": response, "prompt_ids": ids, "output_ids": out, "logprobs": [-1.0] * len(out), "finish_reason": finish, "tool_call": False, "ill_formed": False}


U, A = ("user", "q"), ("assistant", "a")


def test_a_chain_is_one_row():
    rows = J.session_rows([turn([U], "a", [1, 2], [3, 4]), turn([U, A, ("tool", "t")], "b", [1, 2, 3, 4, 5], [6], "length")])
    assert len(rows) == 1 and rows[0]["tokens"] == [1, 2, 3, 4, 5, 6] and rows[0]["loss_mask"] == [1, 1, 0, 1] and rows[0]["logprobs"] == [-1.0, -1.0, 0.0, -1.0] and rows[0]["truncated"]


def test_short_drift_is_laid_over_and_long_drift_forks():
    turns = [turn([U], "a", [1, 2], [3, 4]), turn([U, A, U], "b", [1, 2, 3, 9, 5], [6])]
    (row,) = J.session_rows(turns)
    assert row["tokens"] == [1, 2, 3, 9, 5, 6] and row["loss_mask"] == [0, 0, 0, 1]
    first, second = J.session_rows(turns, threshold=1)
    assert first["loss_mask"] == [1, 1] and second["tokens"] == [1, 2, 3, 9, 5, 6] and second["loss_mask"] == [1]
    early = J.session_rows([turns[0], turn([U, A, U], "b", [1, 8, 3, 4, 5], [6])])
    assert [r["tokens"] for r in early] == [[1, 2, 3, 4], [1, 8, 3, 4, 5, 6]]


def test_shared_responses_are_trained_once():
    turns = [turn([U], "a", [1], [2]), turn([U, A, ("user", "x")], "b", [1, 2, 3], [4]), turn([U, A, ("user", "y")], "c", [1, 2, 5], [6])]
    assert [r["loss_mask"] for r in J.session_rows(turns)] == [[1, 0, 1], [0, 0, 1]]


def test_a_rewrite_takes_the_place_of_a_short_response():
    turns = [turn([U], "a", [1], [2, 3]), turn([U, ("assistant", "a "), U], "b", [1, 2, 4, 5], [6])]
    (row,) = J.session_rows(turns)
    assert row["tokens"] == [1, 2, 4, 5, 6] and row["loss_mask"] == [1]
    assert [r["loss_mask"] for r in J.session_rows(turns, threshold=2)] == [[1, 1], [1]]
    assert J.session_rows([turn([], "a", [1], [2])]) == [] == J.session_rows([])


def test_rows_are_cut_to_their_most():
    (row,) = J.session_rows([turn([U], "a", [1, 2], [3, 4, 5])], most=4)
    assert (row["tokens"], row["loss_mask"], row["response_length"]) == ([1, 2, 3, 4], [1, 1], 2)


def test_sessions_as_a_table(spark):
    schema = "s string, n int, " + J.TURN
    rows = [("x", 2, [("user", "q"), ("assistant", "a"), ("user", "r")], "b", [1, 2, 3], [4], None, None, None, None), ("x", 1, [("user", "q")], "a", [1], [2], [-1.0], "stop", False, None), ("y", 1, None, None, None, None, None, None, None, None)]
    got = J.training_rows(spark.createDataFrame(rows, schema), "s", "n").collect()
    assert [(r["s"], r["tokens"], r["loss_mask"]) for r in got] == [("x", [1, 2, 3, 4], [1, 0, 1])]
    assert J.training_rows(spark.createDataFrame([], schema), "s", "n").collect() == []


def test_masks_by_offsets(spark):
    m = [("user", "hi", None), ("assistant", "<think>\nx", None), ("assistant", "no", 0), ("assistant", "ok", 1)]
    df = spark.createDataFrame([(m,), ([],)], "m array<struct<role:string,content:string,step_loss_mask:int>>")
    row, none = df.select(C.rendered(F.col("m")).alias("t"), C.trained_spans(F.col("m")).alias("s")).collect()
    assert [row["t"][s["start"] : s["end"]] for s in row["s"]] == ["x<|im_end|>\n", "ok<|im_end|>\n"] and none["t"] == "" and none["s"] == []
    tokens = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 2), (2, 2), (2, 4), (9, 12))])
    spans = F.array(F.struct(F.lit(3).alias("start"), F.lit(9).alias("end")))
    assert spark.range(1).select(C.offset_mask(tokens, spans)).first()[0] == [0, 0, 1, 0]
