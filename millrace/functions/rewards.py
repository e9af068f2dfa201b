"""Rewards by rule, their routing by type, and what goes with them: instruction parameters, sandbox outcomes, compressed sizes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import math_rewards
from .text import token_f1, trimmed

LETTERS = [chr(65 + k) for k in range(26)]
#: Where a chosen letter stands, in order of precedence.
CHOSEN = [
    r"(?i)(?:answer|option|choice)\s*(?:is|:)?\s*([A-Z])",
    r"(?i)([A-Z])\s*is\s*(?:the)?\s*correct",
    r"(?i)final\s*(?:answer|option)\s*(?:is|:)?\s*([A-Z])",
]
ALONE = r"(?<![\p{L}\p{N}_])([A-Z])(?![\p{L}\p{N}_])"


def plain_answer(text: Column) -> Column:
    """Lower-case ASCII letters and digits, single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def chosen_letter(answer: Column, valid: Column) -> Column:
    """The first pattern whose first match is a valid letter, else the last valid capital that stands alone."""
    tried = [F.upper(F.nullif(F.regexp_extract(answer, p, 1), F.lit(""))) for p in CHOSEN]
    alone = F.filter(F.regexp_extract_all(answer, F.lit(ALONE), 1), lambda x: F.array_contains(valid, x))
    return F.coalesce(*[F.when(F.array_contains(valid, c), c) for c in tried], F.try_element_at(alone, F.lit(-1)))


def multiple_choice_reward(response: Column, label: Column, choices: Column | None = None, valid_letters: Column | None = None, correct_letter: Column | None = None, correct_answer: Column | None = None) -> Column:
    """1 or 0. A letter that was found decides if the right one is known (given, or the label as a letter or as the text of a
    choice); else the answer may hold the right text, and last a label that is a letter of no known list may be met."""
    none, many = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    choices, given = choices if choices is not None else many, valid_letters if valid_letters is not None else many
    some = F.greatest(F.coalesce(F.size(choices), F.lit(0)), F.lit(0))
    every = F.array(*map(F.lit, LETTERS))
    valid = F.when(F.size(given) > 0, F.transform(given, lambda x: F.upper(x))).when(some > 0, F.slice(every, F.lit(1), some)).otherwise(F.slice(every, 1, 10))
    said, told = F.substring_index(response, "</think>", -1), trimmed(label)
    as_letter = F.when((F.length(told) == 1) & F.array_contains(valid, F.upper(told)), F.upper(told))
    at = F.array_position(F.transform(choices, plain_answer), plain_answer(told))
    as_text = F.when((at > 0) & (told != ""), F.get(valid, (at - 1).cast("int")))
    right = F.coalesce(F.nullif(F.upper(trimmed(correct_letter if correct_letter is not None else none)), F.lit("")), as_letter, as_text)
    found = chosen_letter(said, valid)
    place = F.array_position(valid, right)
    texts = F.array(F.when(place > 0, F.get(choices, (place - 1).cast("int"))), correct_answer if correct_answer is not None else none, told)
    held = F.exists(texts, lambda x: F.coalesce((plain_answer(x) != "") & F.contains(plain_answer(said), plain_answer(x)), F.lit(False)))
    score = F.when(response.isNull(), 0.0).when(found.isNotNull() & right.isNotNull(), (found == right).cast("double")).when(held, 1.0)
    return score.when(found.isNotNull() & right.isNull() & (told != ""), (found == F.upper(told)).cast("double")).otherwise(0.0)


#: Scorers by type: from the response and the label to a number.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "deepscaler": lambda r, g: math_rewards.reasoned_reward(r, g).cast("double"),
    "dapo": lambda r, g: math_rewards.answer_score(r, g)["score"].cast("double"),
    "math": lambda r, g: F.coalesce(math_rewards.boxed_grade(r, g), F.lit(False)).cast("double"),
    "f1": token_f1,
    "gpqa": lambda r, g: multiple_choice_reward(r, g),
}


def routed_reward(name: Column, response: Column, label: Column, scorers: dict[str, Callable[[Column, Column], Column]] | None = None, observed: Column | None = None) -> Column:
    """The score of each row by its type; `observed`, where it isn't null, comes first. A scorer sees the rows of its type
    alone (others are null to it). An unknown or missing type is an error."""
    out = F.when(observed.isNotNull(), observed.cast("double")) if observed is not None else F.when(F.lit(False), 0.0)
    for key, score in (scorers or SCORERS).items():
        mine = name == key
        out = out.when(mine, F.coalesce(score(F.when(mine, response), F.when(mine, label)), F.lit(0.0)))
    return out.otherwise(F.raise_error(F.concat(F.lit("no rule scores the reward type "), F.coalesce(name, F.lit("(none)")))).cast("double"))


def coerced_kwargs(raw: Column, count: Column) -> Column:
    """An array of `count` maps: missing ones repeat the last, more are cut, null values are dropped."""
    empty = F.create_map().cast("map<string,string>")
    given = F.transform(F.coalesce(raw, F.array().cast("array<map<string,string>>")), lambda m: F.coalesce(m, empty))
    last = F.coalesce(F.try_element_at(given, F.lit(-1)), empty)
    full = F.slice(F.concat(given, F.array_repeat(last, F.greatest(count - F.size(given), F.lit(0)))), F.lit(1), count)
    return F.transform(full, lambda m: F.map_filter(m, lambda k, v: v.isNotNull()))


def sandbox_outcome(accepted: Column, statuses: Column, run_statuses: Column, outputs: Column) -> Column:
    """accepted, timeout, sandbox_error, wrong_answer or execution_error, from the statuses of all tests and what they print."""
    has = lambda xs, *parts: F.exists(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.coalesce(F.lower(x).rlike("|".join(parts)), F.lit(False)))
    late = has(statuses, "time") | has(run_statuses, "time")
    outcome = F.when(F.coalesce(accepted, F.lit(False)), "accepted").when(late, "timeout").when(has(statuses, "sandbox_?error"), "sandbox_error")
    return outcome.when(has(outputs, "wrong answer"), "wrong_answer").otherwise("execution_error")


def stable_seed(name: Column, seed: int = 0) -> Column:
    """31 bits of the keyed digest of a name, the same in every process."""
    import hashlib

    @F.pandas_udf("bigint")
    def seeded(names: pd.Series) -> pd.Series:
        digest = lambda x: hashlib.blake2b(f"{seed}:{x}".encode(), digest_size=8).digest()
        return pd.Series([None if x is None else int.from_bytes(digest(x), "little") & 0x7FFFFFFF for x in names], dtype="Int64")

    return seeded(name)


def compression(text: Column, algorithm: str = "zlib", level: int = 9) -> Column:
    """`ratio` (infinite for an empty text) and `savings` in percent, of the UTF-8 bytes."""
    import bz2
    import gzip
    import lzma
    import zlib

    pack = {"zlib": lambda b: zlib.compress(b, level), "gzip": lambda b: gzip.compress(b, level), "bz2": lambda b: bz2.compress(b, level), "lzma": lambda b: lzma.compress(b, preset=level)}[algorithm]

    @F.pandas_udf("ratio double, savings double")
    def packed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            raw = None if t is None else t.encode()
            size = len(pack(raw)) if raw else 0
            rows.append((None, None) if raw is None else (len(raw) / size, 100 * (1 - size / len(raw))) if raw else (float("inf"), 0.0))
        return pd.DataFrame(rows, columns=["ratio", "savings"])

    return packed(text)


def repetitive(text: Column, longer: int = 10_000, ratio: float = 10.0) -> Column:
    """Whether a text of over `longer` characters has a tail of that many which zlib makes over `ratio` times smaller."""
    long = F.length(text) > longer
    return F.coalesce(long & (compression(F.when(long, F.substring(text, -longer, longer)))["ratio"] > ratio), F.lit(False))


def decoded_json(value: Column) -> Column:
    """JSON text from JSON text, or from base64 of zlib of it; null for anything else, pickles too."""
    import base64
    import json
    import zlib

    @F.pandas_udf("string")
    def unpacked(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                text = zlib.decompress(base64.b64decode(v, validate=True)).decode()
                inner = json.loads(text)
                return inner if isinstance(inner, str) else text
            except (ValueError, zlib.error):
                return None

        return values.map(one, na_action="ignore")

    plain = F.try_parse_json(value).isNotNull()
    return F.when(plain, value).otherwise(unpacked(F.when(~plain, value)))


# The parts of the programming prompt.
CODE_TASK = (
    "### Instruction\nYou are an expert Python programmer. You will be given a question (problem specification) and will generate a "
    "correct Python program that matches the specification and passes all tests. You will NOT return anything except for the program.\n\n"
)
CODE_STARTED = "### Format: You will use the following starter code to write the solution to the problem and enclose your code within delimiters.\n```python\n"
CODE_FREE = (
    "### Format: Read the inputs from stdin, solve the problem, and write the answer to stdout (do not directly test on the sample inputs). "
    "Enclose your code within delimiters as follows.\n```python\n```"
)
CODE_END = "\n\n### Answer: (use the provided format with backticks)\n"


def code_prompt(question: Column, starter: Column) -> Column:
    started = F.concat(F.lit(CODE_STARTED), starter, F.lit("\n```"))
    form = F.when(F.coalesce(starter, F.lit("")) != "", started).otherwise(F.lit(CODE_FREE))
    return F.concat(F.lit(CODE_TASK + "### Question:\n"), question, F.lit("\n\n"), form, F.lit(CODE_END))


def code_benchmark_row(question_id: Column, question: Column, starter: Column, difficulty: Column) -> Column:
    """prompt, label, and metadata (reward type, id, difficulty, hash of the question)."""
    from .text import prompt_hash

    meta = F.struct(F.lit("livecodebench").alias("rm_type"), question_id.cast("string").alias("question_id"), F.coalesce(difficulty, F.lit("unknown")).alias("difficulty"), prompt_hash(question).alias("question_sha256"))
    return F.struct(code_prompt(question, starter).alias("prompt"), F.lit("").alias("label"), meta.alias("metadata"))
