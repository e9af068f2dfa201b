"""Grading of mathematical answers: small string helpers inside Arrow functions. Equality is exact; LaTeX beyond fractions
and functions of which nothing is known leave it null, never false."""

from __future__ import annotations

import re
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F

from .algebra import same_expression


def last_box(text: str | None) -> str | None:
    """The last \\boxed command, or where there is none the last \\fbox, up to the brace that closes its first; null if none does."""
    at = (text or "").rfind("\\boxed")
    at = (text or "").rfind("\\fbox") if at < 0 else at
    depth = 0
    for k in range(at, len(text) if at >= 0 else -1):
        depth += (text[k] == "{") - (text[k] == "}")
        if depth == 0 and text[k] == "}":
            return text[at : k + 1]
    return None


def last_boxed(text: str | None) -> str | None:
    """What the last box holds, if it is a \\boxed with its brace right behind."""
    box = last_box(text)
    return box[len("\\boxed{") : -1] if box is not None and box.startswith("\\boxed{") else None


def whole(digits: str) -> int:
    """Of any length; `int` refuses thousands of digits."""
    return int(Decimal(digits))


def rational(text: str | None) -> Fraction | None:
    """Integers, decimals, fractions, LaTeX fractions and mixed numbers; thousands may be marked."""
    t = re.sub(r"\\(?:left|right|!|,|;|\$|%)|[$%\s]", lambda m: " " if m[0].isspace() else "", text or "").strip()
    t = re.sub(r"\\[dt]?frac\s*\{\s*(-?\d+)\s*\}\s*\{\s*(\d+)\s*\}", r" \1/\2", t).strip()
    t = re.sub(r"(?<=\d),(?=\d{3}(?:\D|$))", "", t)
    if m := re.fullmatch(r"(-?)(\d+)\s+(\d+)\s*/\s*(\d+)", t):
        return None if whole(m[4]) == 0 else (Fraction(whole(m[2])) + Fraction(whole(m[3]), whole(m[4]))) * (-1 if m[1] else 1)
    if m := re.fullmatch(r"(-?\s*\d+)\s*/\s*(\d+)", t):
        return None if whole(m[2]) == 0 else Fraction(whole(m[1].replace(" ", "")), whole(m[2]))
    return Fraction(Decimal(t)) if re.fullmatch(r"[-+]?(?:\d+\.?\d*|\.\d+)", t) else None


def bare(text: str | None) -> str:
    return re.sub(r"\\(?:text|mathrm)\{([^{}]*)\}|\s+|\\[!,;]|\$", lambda m: m[1] or "", text or "").lower().rstrip(".")


def same_answer(given: str | None, gold: str | None) -> bool | None:
    """Equal strings, numbers or expressions, tuples part by part; null if none of these can be told."""
    if given is None or gold is None:
        return False
    if bare(given) == bare(gold):
        return True
    inside = lambda s: s.strip()[1:-1].split(",") if re.fullmatch(r"\s*[(\[].*[)\]]\s*", s, re.S) and "," in s else None
    a, b = inside(given), inside(gold)
    if a is not None and b is not None:
        if len(a) != len(b) or given.strip()[0] + given.strip()[-1] != gold.strip()[0] + gold.strip()[-1]:
            return False
        parts = [same_answer(x, y) for x, y in zip(a, b, strict=True)]
        return False if False in parts else None if None in parts else True
    x, y = rational(given), rational(gold)
    if x is not None and y is not None:
        return x == y
    return None if "\\" in given + gold else same_expression(bare(given), bare(gold))


def boxed_column(text):
    @F.pandas_udf("string")
    def box(texts: pd.Series) -> pd.Series:
        return texts.map(last_boxed)

    return box(text)


def box_column(text):
    @F.pandas_udf("string")
    def box(texts: pd.Series) -> pd.Series:
        return texts.map(last_box)

    return box(text)


def same_answer_column(given, gold):
    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_answer(x, y) for x, y in zip(a, b, strict=True)], dtype="object")

    return same(given, gold)
