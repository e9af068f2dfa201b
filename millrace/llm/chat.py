"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once more: that speaker's turns
become the assistant's and carry the training mask, all others become users with a name. The result has a
row for each rendered message, in reading order by `turn`, so a conversation of any length never has to fit
in one task; `assembled` joins the messages of conversations that are known to be short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What the two marks become inside of a text, so that no message can end early.
SAFE_START, SAFE_END = "<| im_start |>", "<| im_end |>"
#: Of the conversation's frame, not of a participant.
FRAME = "system"


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """From conv_id, turn, role, text: a row for each (participant, message).

    conv_id, perspective, turn, speaker, chat_role (assistant, user or system), name (users' only), content,
    segment (the rendered message), mask_start and mask_end (code points of the segment that are trained,
    end exclusive; equal for other speakers).

    `system` is no participant: its turns are in every perspective, as they are and untrained, and a conversation of
    nothing else has no perspective. A null role is a speaker of its own, whose perspective is null. A null text is empty,
    null conversation ids form one conversation, a null turn is kept. Repeated rows and equal turns are kept as they are. An
    empty table gives an empty result; further columns are ignored. Names hold only letters, digits, `_` and `-`; a speaker
    with other characters has them replaced and a hash added, so no two speakers share a name. The marks of the format are
    broken up inside of texts.
    """
    said = turns.select("conv_id", "turn", F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("content"))
    framed = F.col("speaker").eqNullSafe(F.lit(FRAME))
    people = said.filter(~framed).select(F.col("conv_id").alias("in_conv"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    plain = F.coalesce(F.regexp_replace("speaker", "[^A-Za-z0-9_-]", "_"), F.lit("unknown"))
    marked = F.concat(plain, F.lit("_"), F.substring(F.md5(F.coalesce("speaker", F.lit(""))), 1, 8))
    name = F.when(~own & ~framed, F.when(F.col("speaker").eqNullSafe(plain), plain).otherwise(marked))
    role = F.when(framed, F.lit(FRAME)).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    head = F.concat(F.lit(START), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    safe = F.replace(F.replace("content", F.lit(START), F.lit(SAFE_START)), F.lit(END), F.lit(SAFE_END))
    return said.join(people, F.col("conv_id").eqNullSafe(F.col("in_conv"))).select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        role.alias("chat_role"),
        name.alias("name"),
        "content",
        F.concat(head, safe, F.lit(END + "\n")).alias("segment"),
        F.length(head).alias("mask_start"),
        (F.length(head) + F.when(own, F.length(safe) + len(END)).otherwise(0)).alias("mask_end"),
    )


def assembled(rendered: DataFrame) -> DataFrame:
    """One text for each (conversation, perspective). Only for conversations that fit in a row."""
    return (
        rendered.groupBy("conv_id", "perspective")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "content", "segment"))).alias("messages"))
        .select("conv_id", "perspective", F.array_join(F.transform("messages", lambda m: m["segment"]), "").alias("dialogue"))
    )


ROTATE_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS content FROM conversations
), people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker IS DISTINCT FROM '{FRAME}'),
seen AS (
  SELECT s.conv_id, p.perspective, s.turn, s.speaker, s.content, s.speaker IS NOT DISTINCT FROM p.perspective AS own,
         s.speaker IS NOT DISTINCT FROM '{FRAME}' AS framed,
         coalesce(regexp_replace(s.speaker, '[^A-Za-z0-9_-]', '_', 'g'), 'unknown') AS plain,
         replace(replace(s.content, '{START}', '{SAFE_START}'), '{END}', '{SAFE_END}') AS safe
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), named AS (
  SELECT *, CASE WHEN own OR framed THEN NULL WHEN speaker IS NOT DISTINCT FROM plain THEN plain
                 ELSE plain || '_' || substr(md5(coalesce(speaker, '')), 1, 8) END AS name,
         CASE WHEN framed THEN '{FRAME}' WHEN own THEN 'assistant' ELSE 'user' END AS chat_role
  FROM seen
), headed AS (
  SELECT *, '{START}' || chat_role || coalesce(' name=' || name, '') || chr(10) AS head FROM named
)
SELECT conv_id, perspective, turn, speaker, chat_role, name, content,
       head || safe || '{END}' || chr(10) AS segment,
       length(head)::INT AS mask_start,
       (length(head) + CASE WHEN own THEN length(safe) + {len(END)} ELSE 0 END)::INT AS mask_end
FROM headed
"""
