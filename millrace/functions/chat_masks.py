"""Loss masks of templated conversations, turn by turn or by character offsets. How a text falls into tokens is a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Pieces = Callable[[Column], Column]
# The markers of the template.
START, END, THINK = "<|im_start|>", "<|im_end|>\n", "<think>\n"


def plain_pieces(text: Column) -> Column:
    """Words and single other characters."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]"), 0)


def header(role: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"))


def body(content: Column) -> Column:
    return F.concat(F.coalesce(content, F.lit("")), F.lit(END))


def turn_mask(role: Column, content: Column, step_mask: Column, pieces: Pieces = plain_pieces) -> Column:
    """Zeros for the header, ones for what an assistant says and its end; zeros alone for others and for a turn whose
    `step_mask` is given and isn't 1."""
    head, rest = F.size(pieces(header(role))), F.size(pieces(body(content)))
    trained = (role == "assistant") & F.coalesce(step_mask == 1, F.lit(True))
    return F.concat(F.array_repeat(F.lit(0), head), F.array_repeat(F.when(trained, 1).otherwise(0), rest))


def grouped_turn_text(role: Column, content: Column, before: Column, after: Column) -> Column:
    """The text of a turn where neighbouring tool turns share one user turn; `before` and `after` are the neighbours' roles."""
    first, last = F.coalesce(before != "tool", F.lit(True)), F.coalesce(after != "tool", F.lit(True))
    tool = F.concat(
        F.when(first, F.lit(START + "user")).otherwise(""), F.lit("\n<tool_response>\n"), F.coalesce(content, F.lit("")), F.lit("\n</tool_response>"), F.when(last, F.lit(END)).otherwise("")
    )
    return F.when(role == "tool", tool).otherwise(F.concat(header(role), body(content)))


def grouped_turn_mask(role: Column, content: Column, before: Column, after: Column, step_mask: Column, pieces: Pieces = plain_pieces) -> Column:
    text = grouped_turn_text(role, content, before, after)
    return F.when(role == "tool", F.array_repeat(F.lit(0), F.size(pieces(text)))).otherwise(turn_mask(role, content, step_mask, pieces))


def rendered(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(header(m["role"]), body(m["content"]))), "")


def trained_spans(messages: Column) -> Column:
    """(start, end) of the characters that are trained in `rendered(messages)`: what an assistant says after its header
    and an opening think tag, to the end of its turn, unless its step_loss_mask is given and isn't 1."""

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(header(m["role"]))
        end = start + F.length(body(m["content"]))
        skip = F.when(F.startswith(m["content"], F.lit(THINK)), len(THINK)).otherwise(0)
        span = F.struct((start + skip).cast("int").alias("start"), end.cast("int").alias("end"))
        trained = (m["role"] == "assistant") & F.coalesce(m["step_loss_mask"] == 1, F.lit(True))
        return F.struct(end.cast("int").alias("at"), F.when(trained, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(messages, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def offsets(pieces: Column) -> Column:
    """(start, end) of pieces laid end to end."""
    laid = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, p: F.struct((acc["at"] + F.length(p)).cast("int").alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p)).cast("int").alias("end"))).alias("out")),
    )
    return laid["out"]


def offset_mask(tokens: Column, spans: Column) -> Column:
    """1 for a token (start, end) that shares a character with a span; empty tokens are 0."""
    return F.transform(tokens, lambda t: ((t["end"] > t["start"]) & F.exists(spans, lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"]))).cast("int"))


def distilled_mask(first: Column, last: Column, pieces: Pieces = plain_pieces) -> Column:
    """The first message is the prompt, the last one's content the response; what lies between is left out."""
    prompt = F.concat(header(first["role"]), body(first["content"]), header(F.lit("assistant")))
    trained = F.when(F.coalesce(last["step_loss_mask"] == 1, F.lit(True)), 1).otherwise(0)
    return F.concat(F.array_repeat(F.lit(0), F.size(pieces(prompt))), F.array_repeat(trained, F.size(pieces(F.coalesce(last["content"], F.lit(""))))))
