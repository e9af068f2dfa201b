"""Answer normalisers and reward ladders as Column expressions; only balanced braces and exact rationals need a helper."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import algebra
from .math_answers import boxed_column

# What the final-answer normaliser replaces, in order, and what it then removes.
REPLACED = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes",
    "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples",
    "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}",
    "\\;", ",\\!", "{,}", '"', "\\dots", "<|im_end|>", "<|endoftext|>",
]
# Units that an answer may carry, in order; scale words and their powers.
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard"]
SCALES = [("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]
# How LaTeX commands read as text.
SYMBOLS = [("\\pi", "pi"), ("\\infty", "inf"), ("\\cup", "U"), ("\\cdot", "*"), ("\\times", "*")]


def replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often it stands in the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def occurrences(text: Column, part: str) -> Column:
    return F.regexp_count(text, F.lit(re.escape(part)))


def unwrapped_text(text: Column) -> Column:
    r"""What a \text{} around the whole holds."""
    return F.regexp_replace(text, r"^\\text\{([^\n]+)\}$", "$1")


def bare_latex(text: Column) -> Column:
    """The MATH style of writing an answer: no spaces, units on the right, degrees or size commands; braces around the
    parts of fractions and roots; a/b and 0.5 as fractions. Where a command lacks its argument, the answer stays as it is."""
    return let(F.trim(unwrapped_text(F.trim(text))), _bare)


def _bare(start: Column) -> Column:
    t = replaced(
        start, ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")
    )
    return let(t, lambda u: _with_arguments(start, u))


def _with_arguments(start: Column, t: Column) -> Column:
    broken = occurrences(t, "\\text{ ") > 1
    t = replaced(F.substring_index(t, "\\text{ ", 1), ("\\%", ""), (" .", " 0."), ("{.", "{0."))
    t = F.regexp_replace(t, r"^\.", "0.")
    t = F.regexp_replace(t, r"^[^=]{0,2}=([^=]*)$", "$1")
    broken = broken | t.rlike(r"\\sqrt($|\\sqrt)")
    t = replaced(F.regexp_replace(t, r"\\sqrt([^{])", r"\\sqrt{$1}"), (" ", ""))
    broken = broken | t.rlike(r"\\frac($|\\frac)")
    return F.when(broken, start).otherwise(let(t, _with_braces))


def _with_braces(t: Column) -> Column:
    full = F.regexp_replace(F.regexp_replace(t, r"\\frac([^{])\{", r"\\frac{$1}{"), r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    t = F.when(t.rlike(r"\\frac[^{]($|\\frac)"), t).otherwise(full)
    t = F.regexp_replace(t, r"^(-?[1-9][0-9]*|0)/(-?[1-9][0-9]*|0)$", r"\\frac{$1}{$2}")
    return F.regexp_replace(t, r"^0\.5$", r"\\frac{1}{2}")


def same_bare_latex(given: Column, gold: Column) -> Column:
    return bare_latex(given) == bare_latex(gold)


def whole(text: Column) -> Column:
    """The number that the text writes, thousands marked or not, if it is whole, as digits; else null."""
    number = F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9]{3}([^0-9]|$))", "")
    exact = F.when(number.rlike(r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]{1,2})?\s*$"), number.try_cast("double"))
    return F.when((F.abs(exact - F.round(exact)) <= 1e-7) & (F.abs(exact) < 9e15), F.round(exact).cast("bigint").cast("string"))


def plain_expression(text: Column) -> Column:
    """An answer as plain arithmetic: no units, currency or braces, scale words as powers, mixed numbers as sums, lower case."""
    t = replaced(unwrapped_text(text), ("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), *SCALES)
    for unit in UNITS:
        t = F.regexp_replace(t, unit + r"(es)?(s)? *(\^[0-9]+)?", "")
    t = F.regexp_replace(t, r"\^ *\\circ", "")
    t = F.regexp_replace(t, r"^\{([\s\S]*)\}$", "$1")
    t = F.regexp_replace(t, r",\\! *", "")
    return let(let(t, lambda u: F.when(~F.contains(u, F.lit(",")), F.coalesce(whole(u), u)).otherwise(u)), _read)


def _read(t: Column) -> Column:
    read = F.regexp_replace(F.regexp_replace(t, r"\\[td]?frac *\{([^{}]*)\} *\{([^{}]*)\}", " $1/$2"), r"\\sqrt *\{([^{}]*)\}", "sqrt($1)")
    read = F.trim(F.regexp_replace(replaced(read, *SYMBOLS), r"\\(left|right|text|mathrm|mathbf|[,;! ])", ""))
    t = F.when(F.contains(t, F.lit("\\")), read).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, "- *", "-"), "([0-9]) +(?=[0-9])", "$1+")
    t = F.lower(replaced(t, (" ", ""), ("{", ""), ("}", "")))
    return let(t, lambda u: F.coalesce(whole(u), u))


def graded(given: str | None, gold: str | None) -> bool | None:
    """Plain expressions part by part. Fractions must be reduced alike, whole numbers be written whole; other parts
    are equal if their difference is zero as an expression. Null only where that rests on a function of which nothing is known."""
    if gold is None or given is None or not given:
        return given == gold and gold is not None
    if given == gold:
        return True
    bracketed = len(gold) > 2 and gold[0] in "([" and gold[-1] in ")]" and "," in gold
    if bracketed and (given[0] != gold[0] or given[-1] != gold[-1]):
        return False
    inside = lambda s: s[1:-1].split(",") if len(s) > 2 and s[0] in "([" and s[-1] in ")]" else [s]
    a, b = inside(given), inside(gold)
    if len(a) != len(b):
        return False
    known = True
    for x, y in zip(a, b, strict=True):
        fraction, integer = r"-?[0-9]+\.?/0*[1-9][0-9]*\.?", r"-?[0-9]+"
        if x == y:
            continue
        if re.fullmatch(fraction, x) and re.fullmatch(fraction, y) or bool(re.fullmatch(integer, x)) or bool(re.fullmatch(integer, y)):
            return False
        equal = algebra.same_expression(y, x)
        if equal is False:
            return False
        known = known and equal is not None
    return True if known else None


def same_expression(given: Column, gold: Column) -> Column:
    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([graded(x, y) for x, y in zip(a, b, strict=True)], dtype="object")

    return same(plain_expression(given), plain_expression(gold))


def answer_of(text: Column) -> Column:
    r"""What the last \boxed{} holds, if there is one."""
    return F.when(F.contains(text, F.lit("\\boxed")), boxed_column(text))


def boxed_grade(response: Column, gold: Column) -> Column:
    """Whether the boxed answer equals the gold one in either way of writing; null where that can't be told."""
    truth = F.when(F.contains(gold, F.lit("\\boxed")), answer_of(gold)).otherwise(gold)
    given = answer_of(response)
    found = F.when(F.coalesce(same_bare_latex(given, truth), F.lit(False)), F.lit(True)).otherwise(same_expression(given, truth))
    return F.when(given.isNull() | truth.isNull() | (gold == ""), F.lit(False)).otherwise(found)


def reasoned_reward(response: Column, gold: Column) -> Column:
    """1 or 0 for what follows the reasoning: after the last </think>, else after the first ###Response, else all of it."""
    after = F.get(F.split(response, "###Response"), F.lit(1))
    solution = F.when(F.contains(response, F.lit("</think>")), F.substring_index(response, "</think>", -1)).otherwise(F.coalesce(after, response))
    return boxed_grade(solution, gold).cast("int")


def final_answer(text: Column) -> Column:
    """The right-hand side without words, units and LaTeX dressing; whole numbers lose their commas."""
    t = replaced(F.substring_index(text, "=", -1), *REPLACED, *[(x, "") for x in REMOVED])
    t = F.regexp_replace(t, r"[^\n$]*\$([^\n$]*)\$[^\n]*", r"\$$1\$")
    for command in ("text", "textbf", "overline"):
        t = F.regexp_replace(t, r"\\" + command + r"\{([^\n}]*)\}", "$1")
    t = F.regexp_replace(t, r"\\boxed\{([^\n]*)\}", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"frac([^{])([^\n])", "frac{$1}{$2}"), "sqrt([^{])", "sqrt{$1}")
    t = replaced(t, ("$", ""))
    number = replaced(t, (",", ""))
    return F.regexp_replace(F.when(number.rlike("^[0-9]+$"), number).otherwise(t), r"^\s+|\s+$", "")


def line_prediction(response: Column) -> Column:
    found = F.regexp_extract_all(response, F.lit(r"(?i)answer\s*:\s*([^\n]+)"), 1)
    return final_answer(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("[INVALID]")))


def line_grade(response: Column, gold: Column) -> Column:
    """Whether the last `Answer:` line holds the gold number, cut to a whole one; null for a gold text that is none."""
    return line_prediction(response) == final_answer(gold).try_cast("double").cast("bigint").cast("string")


def box_grade(response: Column, gold: Column, tail: int = 100) -> Column:
    """1 if the last box within the last `tail` characters is the gold text itself, else -1."""
    return F.when(F.coalesce(boxed_column(F.right(response, F.lit(tail))) == gold, F.lit(False)), 1).otherwise(-1)


def answer_score(response: Column, gold: Column, strict_box: bool = False, tail: int = 300) -> Column:
    """(score, acc, pred) from the last `tail` characters, by the box or by the `Answer:` line."""
    end = F.right(response, F.lit(tail))
    pred = boxed_column(F.right(end, F.lit(100))) if strict_box else line_prediction(end)
    acc = box_grade(end, gold) == 1 if strict_box else line_grade(end, gold)
    return F.struct(F.when(acc, 1.0).otherwise(-1.0).alias("score"), acc.alias("acc"), pred.alias("pred"))


def tool_use_reward(score: Column, turns: Column) -> Column:
    """A wrong answer earns up to -0.6 by using tools."""
    return F.when(score < 0, F.least(F.lit(-0.6), score + (turns - 2) / 2 * 0.1)).otherwise(score)


TAG = "</?(?:think|search|information|answer)>"


def valid_tag_sequence(text: Column) -> Column:
    """After the first assistant marker: think, then any number of (search, information, think), then answer, with
    nothing but blanks between them. Two passes over the text: its tags, and what lies between them."""
    marker = r"<\|im_start\|>assistant\s*"
    content = F.get(F.split(text, marker, 2), F.lit(1))
    tags = F.array_join(F.regexp_extract_all(content, F.lit(f"({TAG})"), 1), "")
    order = tags.rlike("^(?:<think></think><search></search><information></information>)*<think></think><answer></answer>$")
    outside = F.filter(F.split(content, TAG, -1), lambda x, i: (i % 2 == 0) & ~x.rlike(r"^\s*$"))
    return F.coalesce(order & (F.size(outside) == 0), F.lit(False))
