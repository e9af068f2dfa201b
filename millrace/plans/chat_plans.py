"""Loss masks and agent sessions over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import chat_masks as C
from ..operators import trajectories as J
from .base import Registry, table

R = Registry()
N = "len(regexp_extract_all({0},'[A-Za-z0-9_]+|[^A-Za-z0-9_]'))"
HEAD, BODY = "'<|im_start|>'||role||chr(10)", "coalesce(text,'')||'<|im_end|>'||chr(10)"
TURNS = "SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM (SELECT conv_id, turn, CASE WHEN turn%4=2 THEN 'tool' WHEN turn%4=3 THEN 'tool' ELSE role END AS role, text FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
TOOL = "(CASE WHEN coalesce(before<>'tool',true) THEN '<|im_start|>user' ELSE '' END)||chr(10)||'<tool_response>'||chr(10)||coalesce(text,'')||chr(10)||'</tool_response>'||(CASE WHEN coalesce(after<>'tool',true) THEN '<|im_end|>'||chr(10) ELSE '' END)"


def counted(df, mask):
    return df.select("conv_id", "turn", mask.alias("m")).select("conv_id", "turn", F.size("m").alias("tokens"), F.aggregate("m", F.lit(0), lambda s, x: s + x).alias("trained"))


def said(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


@R.add(f"SELECT conv_id, turn, ({N.format(HEAD)}+{N.format(BODY)})::INT AS tokens, CASE WHEN role='assistant' AND turn%5<>3 THEN {N.format(BODY)} ELSE 0 END::INT AS trained FROM conversations")
def ta33_turn_masks(spark, sf):
    step = F.when(F.col("turn") % 5 == 3, 0)
    return counted(said(spark, sf), C.turn_mask(F.col("role"), F.col("content"), step))


@R.add(f"SELECT conv_id, turn, CASE WHEN role='tool' THEN {N.format(TOOL)} ELSE {N.format(HEAD)}+{N.format(BODY)} END::INT AS tokens, CASE WHEN role='assistant' THEN {N.format(BODY)} ELSE 0 END::INT AS trained FROM ({TURNS})")
def ta34_grouped_tool_masks(spark, sf):
    role = F.when((F.col("turn") % 4).isin(2, 3), "tool").otherwise(F.col("role"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = said(spark, sf).withColumn("role", role).withColumn("before", F.lag("role").over(w)).withColumn("after", F.lead("role").over(w))
    return counted(t, C.grouped_turn_mask(F.col("role"), F.col("content"), F.col("before"), F.col("after"), F.lit(None).cast("int")))


@R.add(f"SELECT conv_id, turn, ({N.format(HEAD)}+{N.format(BODY)})::INT AS tokens, CASE WHEN role='assistant' THEN {N.format(BODY)} ELSE 0 END::INT AS trained FROM conversations")
def ta35_offset_masks(spark, sf):
    """A conversation of one turn each, so that the mask by offsets equals the one by turns."""
    one = F.array(F.struct("role", "content", F.lit(None).cast("int").alias("step_loss_mask")))
    t = said(spark, sf).withColumn("one", one)
    return counted(t, C.offset_mask(C.offsets(C.plain_pieces(C.rendered(F.col("one")))), C.trained_spans(F.col("one"))))


@R.add(f"SELECT conv_id, turn, ({N.format(HEAD)}+{N.format(BODY)}+{N.format(chr(39) + '<|im_start|>assistant' + chr(39) + '||chr(10)')}+{N.format('coalesce(text,' + chr(39) * 2 + ')')})::INT AS tokens, {N.format('coalesce(text,' + chr(39) * 2 + ')')}::INT AS trained FROM conversations")
def ta36_distilled_masks(spark, sf):
    m = F.struct("role", "content", F.lit(1).alias("step_loss_mask"))
    return counted(said(spark, sf), C.distilled_mask(m, m))


@R.add(
    """WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS held, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS output FROM lineitem GROUP BY 1),
p AS (SELECT *, len(held)//2 AS start, list_transform(held, lambda x, i: CASE WHEN x%11=0 THEN -x ELSE x END)||[-1] AS prompt FROM l),
c AS (SELECT *, coalesce(list_position(list_transform(held, lambda x, i: x=prompt[i]), false), len(held)+1)-1 AS same FROM p)
SELECT l_orderkey, CASE WHEN same=len(held) THEN 'clean' WHEN same>=start AND len(output)<6 THEN 'realign' ELSE 'fork' END AS kind FROM c"""
)
def ta40_drift_kind(spark, sf):
    """Parts of an order as held tokens, of which the prompt changes every eleventh; the later half is the last response."""
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c))), lambda x: x[c])
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(of("l_partkey").alias("held"), of("l_suppkey").alias("output"))
    prompt = F.concat(F.transform("held", lambda x: F.when(x % 11 == 0, -x).otherwise(x)), F.array(F.lit(-1).cast("bigint")))
    return o.select("l_orderkey", J.drift_kind(F.col("held"), F.floor(F.size("held") / 2).cast("int"), prompt, F.col("output"), 6).alias("kind"))


@R.add("SELECT conv_id, 0 AS \"row\", (2*count(*))::INT AS n, count(*)::INT AS trained FROM conversations GROUP BY conv_id")
def ta41_training_rows(spark, sf):
    """A session each conversation: every turn is answered by one token, and each prompt continues all before."""
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    # Numbers of turns are small, what is made of them isn't: they are dealt to as many tasks as the session has, not to one.
    t = t.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    t = t.withColumn("i", F.explode(F.sequence(F.lit(1), "n"))).withColumn("i", F.col("i").cast("int"))
    message = lambda k: F.struct(F.when(k % 2 == 1, "user").otherwise("assistant").alias("role"), k.cast("string").alias("content"))
    turns = t.select(
        "conv_id", "i", F.transform(F.sequence(F.lit(1), 2 * F.col("i") - 1), message).alias("prompt"), (2 * F.col("i")).cast("string").alias("response"), F.sequence(F.lit(1), 2 * F.col("i") - 1).alias("prompt_ids"),
        F.array(2 * F.col("i")).alias("output_ids"), F.array(F.lit(-0.5)).alias("logprobs"), F.lit("stop").alias("finish_reason"), F.lit(False).alias("tool_call"), F.lit(False).alias("ill_formed"),
    )
    rows = J.training_rows(turns, "conv_id", "i")
    return rows.select("conv_id", "row", F.size("tokens").alias("n"), F.aggregate("loss_mask", F.lit(0), lambda s, x: s + x).alias("trained"))
