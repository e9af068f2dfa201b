"""Benchmark rows, links, shaped rewards and performance figures, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The instructions of the benchmark prompts.
CHOICE_INSTRUCTION = "Answer the following multiple choice question. The last line of your response should be of the following format: 'Answer: $LETTER' (without quotes) where LETTER is one of ABCD. Think step by step before answering."


def choice_row(key: Column, question: Column, correct: Column, others: list[Column], seed: int) -> Column:
    """(prompt, label, choices): the correct choice in a slot that the key's hash draws, the others around it in order."""
    slot = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(len(others) + 1)).cast("int")
    choices = F.array_insert(F.array(*[F.trim(o) for o in others]), slot + 1, F.trim(correct))
    letters = "ABCDEFGH"[: len(others) + 1]
    lines = F.array_join(F.transform(choices, lambda c, i: F.concat(F.substring(F.lit(letters), i + 1, F.lit(1)), F.lit(") "), c)), "\n")
    prompt = F.concat(F.lit(CHOICE_INSTRUCTION + "\n\n"), F.trim(question), F.lit("\n\n"), lines)
    return F.struct(prompt.alias("prompt"), F.substring(F.lit(letters), slot + 1, F.lit(1)).alias("label"), choices.alias("choices"))


def math_row(problem: Column, answer: Column, instruction: str, source: str, **metadata: Column) -> Column:
    """(prompt, label, data_source, metadata); the label is the given answer, never read from a solution."""
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(instruction), problem).alias("content")))
    return F.struct(prompt.alias("prompt"), F.trim(answer).alias("label"), F.lit(source).alias("data_source"), F.struct(*[c.alias(k) for k, c in metadata.items()]).alias("metadata"))


def link_extension(link: Column) -> Column:
    """From the last dot of the last part of the path on; empty without one, or if only dots stand before it."""
    return F.regexp_extract(link, r"[^/.][^/]*(\.[^/.]*)$", 1)


def page_links(df: DataFrame, items: str) -> DataFrame:
    """`link` of each of `items` (link, mime) that has no mime type and looks like a page."""
    e = df.select(F.explode(items).alias("item"))
    return e.filter(F.col("item.mime").isNull() & link_extension(F.col("item.link")).isin("", ".html", ".htm", ".shtml")).select("item.link")


def scaled_by_role(reward: Column, role: Column, weights: dict[str, float]) -> Column:
    return reward * F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), role), F.lit(1.0))


def performance(flops: Column, tokens: Column, timers: dict[str, Column]) -> dict[str, Column]:
    """Figures of a step from its timers in seconds (absent ones are null, and so is what needs them)."""
    t = lambda k: F.nullif(timers.get(k, F.lit(None).cast("double")), F.lit(0.0))
    step = F.nullif(timers.get("train_wait", F.lit(None).cast("double")) + timers.get("train", F.lit(None).cast("double")), F.lit(0.0))
    return {
        "log_probs_tflops": flops / t("log_probs"), "ref_log_probs_tflops": flops / t("ref_log_probs"), "actor_train_tflops": 3 * flops / t("actor_train"),
        "actor_train_tok_per_s": tokens / t("actor_train"), "step_time": step, "wait_time_ratio": timers.get("train_wait", F.lit(None).cast("double")) / step,
    }


def request_attributes(meta: Column, wanted: list[str], prefix: str) -> Column:
    """The wanted entries of a map that hold something, under prefixed names."""
    return F.transform_keys(F.map_filter(meta, lambda k, v: k.isin(wanted) & v.isNotNull()), lambda k, v: F.concat(F.lit(prefix), k))


def rank_balance(df: DataFrame, utilisation: str, span: str, most: float = 5.0) -> DataFrame:
    """Ranges over ranks, and whether utilisation (%) differs by more than `most`."""
    g = df.agg(F.min(utilisation).alias("low"), F.max(utilisation).alias("high"), F.min(span).alias("shortest"), F.max(span).alias("longest"))
    return g.withColumn("spread", F.col("high") - F.col("low")).withColumn("imbalanced", F.col("spread") > most)


def test_counts(passed: Column, failed: Column) -> Column:
    n = lambda a: F.coalesce(F.size(a), F.lit(0))
    return F.struct(F.greatest(n(passed), F.lit(0)).alias("passed"), (F.greatest(n(passed), F.lit(0)) + F.greatest(n(failed), F.lit(0))).alias("total"))


def changed_positions(new: Column, changed: Column) -> Column:
    """(count, positions, values) of the elements whose mask is set."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(new) - 1, F.lit(0))), lambda i: F.coalesce(F.get(changed, i), F.lit(False)))
    return F.struct(F.size(at).alias("count"), at.alias("positions"), F.transform(at, lambda i: F.get(new, i)).alias("values"))


def violations(df: DataFrame, run: str, rules: dict[str, Column]) -> DataFrame:
    """(run, message) of every rule that a run breaks; a rule that is null is broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for m, ok in rules.items()]), lambda m: m.isNotNull())
    return df.select(run, F.explode(broken).alias("message")).distinct()


def run_errors(runs: DataFrame, events: DataFrame, declared: DataFrame, required: list[str]) -> DataFrame:
    """(run, message) of everything that is wrong with `runs` (run, status, fields as a map of texts) and their `events` (run, stream, step, digest,
    a number that tells a row's content), of which `declared` (run, stream, rows, digest) says what there should be.

    Required fields that are missing or empty; a status other than complete; streams that were declared and have no row, or have rows and
    weren't declared; another number of rows, or another sum of digests, than declared; steps that come twice, and gaps between
    steps. Events of runs that aren't listed don't count. Rows are counted by step before anything is joined."""
    fields = F.explode(F.array(*map(F.lit, required))) if required else F.explode(F.expr("cast(array() AS array<string>)"))
    told = F.coalesce(F.try_element_at("fields", F.col("field")), F.lit(""))
    missing = runs.select("run", "fields", fields.alias("field")).filter(F.trim(told) == "").select("run", F.concat(F.lit("missing "), "field").alias("message"))
    status = runs.filter(~F.col("status").eqNullSafe(F.lit("complete"))).select("run", F.concat(F.lit("status is "), F.coalesce("status", F.lit("missing"))).alias("message"))
    steps = events.groupBy("run", "stream", "step").agg(F.count("*").alias("n"), F.sum("digest").alias("d"))
    found = steps.groupBy("run", "stream").agg(F.sum("n").alias("found"), F.max("n").alias("most"), F.count("*").alias("steps"), (F.max("step") - F.min("step") + 1).alias("span"), F.sum("d").alias("is"))
    both = declared.withColumnRenamed("digest", "should").join(found, ["run", "stream"], "full").join(runs.select("run"), "run", "left_semi")
    say = lambda holds, *text: F.when(holds, F.concat(*[F.lit(t) if isinstance(t, str) and t not in ("rows", "found") else F.col(t).cast("string") for t in text]))
    there, asked = F.col("found").isNotNull(), F.col("rows").isNotNull()
    messages = F.array(
        say(~there, "no rows"), say(~asked, "not declared"), say(there & asked & (F.col("found") != F.col("rows")), "found", " rows, ", "rows", " are declared"),
        say(there & asked & ~F.col("is").eqNullSafe(F.col("should")), "digest differs"), say(there & (F.col("most") > 1), "steps repeat"), say(there & (F.col("steps") < F.col("span")), "steps have gaps"),
    )
    streams = both.select("run", "stream", F.explode(F.filter(messages, lambda m: m.isNotNull())).alias("m")).select("run", F.concat("stream", F.lit(": "), "m").alias("message"))
    return missing.unionByName(status).unionByName(streams)
