"""Quality rules: a decision list, learned by sequential covering from labelled statistics, in DataFrame functions only.

Every text is reduced to a few counts in one pass, without a shuffle. Ratios of these are laid on fixed grids, so a condition
is a comparison with a round number and all thresholds of all ratios are judged by one table of counts, which has the same few
rows for any number of labelled documents. A rule grows condition by condition on two thirds of the labelled rows, is pruned on the
other third, and takes away what it covers; the list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, release, written

#: What separates words; everything else is part of one.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?"
#: Grid of each ratio: steps to one, and the highest step. Values beyond it count as the highest.
GRIDS = {
    "word_chars_per_word": (4, 80),
    "symbols_per_word": (32, 64),
    "marks_per_word": (32, 64),
    "exclamations_per_word": (32, 64),
    "capitals_per_char": (64, 64),
    "digits_per_char": (64, 64),
    "dup_lines_per_line": (32, 32),
    "repeat_words_per_word": (32, 32),
    "distinct_words_per_word": (32, 32),
    "lines_per_word": (64, 64),
    "log2_words": (2, 60),
}
#: More than any array holds; one more would overflow.
ALL = 2**30


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    step: int

    def on(self, steps: str = "") -> Column:
        at = F.col(f"{steps}{self.ratio}")
        return at > self.step if self.above else at <= self.step

    def __str__(self) -> str:
        each = GRIDS[self.ratio][0]
        return f"{self.ratio} >= {(self.step + 1) / each:g}" if self.above else f"{self.ratio} < {(self.step + 1) / each:g}"


Rule = tuple[Condition, ...]


def counted(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Each row of `docs` (doc_id, text, and what else it has) with doc_id, its counts, and `row`: all its columns, or those of
    `keep`. Null is an empty text."""
    rows = docs.select(packed(docs if keep is None else docs.select(*keep)).alias("row"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    letters = F.translate("text", SPACE, "")
    split = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACE, "") != "")
    gone = lambda what: F.length("text") - F.length(F.translate("text", what, ""))
    found = rows.select(
        "row", "doc_id", split.alias("words"), lines.alias("lines"), F.length(letters).alias("word_chars"), gone(SYMBOLS).alias("n_symbols"), gone(MARKS).alias("n_marks"), gone("!").alias("n_exclamations"), gone("0123456789").alias("n_digits"),
        (F.length(letters) - F.length(F.regexp_replace(letters, "\\p{Lu}+", ""))).alias("n_capitals"),
    )
    # Windows of three words as (hash, place), in order of the hash: equal ones are neighbours.
    three = F.slice(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, ALL).alias("b"), F.slice("words", 3, ALL).alias("c")), F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))
    found = found.withColumn("windows", F.sort_array(F.transform(three, lambda w, i: F.struct(F.xxhash64(w["a"], w["b"], w["c"]).alias("h"), i.alias("at")))))
    both = F.zip_with("windows", F.slice("windows", 2, ALL), lambda x, y: F.when(x["h"] == y["h"], F.array(x["at"], y["at"])).otherwise(F.expr("cast(array() AS array<int>)")))
    found = found.withColumn("starts", F.sort_array(F.array_distinct(F.flatten(both))))
    covered = F.aggregate(F.zip_with("starts", F.slice("starts", 2, ALL), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    long = lambda c, name: c.cast("bigint").alias(name)
    return found.select(
        "row",
        "doc_id",
        long(F.size("words"), "n_words"),
        long(F.col("word_chars"), "word_chars"),
        long(F.col("n_symbols"), "n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        long(covered, "n_repeat_words"),
        long(F.size("lines"), "n_lines"),
        long(F.size(F.array_distinct("words")), "n_distinct"),
        *[long(F.col(c), c) for c in ("n_marks", "n_exclamations", "n_digits", "n_capitals")],
    )


def steps() -> dict[str, Column]:
    """The step of each ratio on its grid. A text without words has ratios of zero."""
    each = {
        "word_chars_per_word": ("word_chars", "n_words"),
        "symbols_per_word": ("n_symbols", "n_words"),
        "marks_per_word": ("n_marks", "n_words"),
        "exclamations_per_word": ("n_exclamations", "n_words"),
        "capitals_per_char": ("n_capitals", "word_chars"),
        "digits_per_char": ("n_digits", "word_chars"),
        "dup_lines_per_line": ("n_dup_lines", "n_lines"),
        "repeat_words_per_word": ("n_repeat_words", "n_words"),
        "distinct_words_per_word": ("n_distinct", "n_words"),
        "lines_per_word": ("n_lines", "n_words"),
    }
    # Whole numbers throughout, so that no rounding decides.
    out = {name: F.floor(F.col(a) * GRIDS[name][0] / F.greatest(F.col(b), F.lit(1))) for name, (a, b) in each.items()}
    out["log2_words"] = F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1))) * GRIDS["log2_words"][0])
    return {name: F.least(c, F.lit(GRIDS[name][1])).cast("int").alias(name) for name, c in out.items()}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def labelled(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """(bad, grows, the steps) of rows with a label. Of equal labels of a document one counts, contradicting ones teach nothing."""
    said = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("of")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    said = said.filter(F.col("low") == F.col("high")).select("of", (F.col("low") == 0).alias("bad"))
    known = counts.filter(~base_failed()).select("doc_id", *steps().values())
    return known.join(said, F.col("doc_id") == F.col("of")).select("bad", (F.crc32(F.col("doc_id").cast("string")) % 3 != 0).alias("grows"), *GRIDS)


def _covers(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.on() for c in rule], F.lit(True))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """How much better (in bits, over the rows that are kept) bad ones are told after a condition than before."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _grown(rows: DataFrame, most: int) -> Rule:
    """Conditions are added while they help; each round is one table of counts by ratio, step and label."""
    rule: Rule = ()
    while len(rule) < most:
        cells = F.explode(F.array(*[F.struct(F.lit(name).alias("ratio"), F.col(name).alias("step")) for name in GRIDS]))
        table = rows.filter(F.col("grows") & _covers(rule)).select("bad", cells.alias("cell")).groupBy("cell.ratio", "cell.step").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        at = {(r["ratio"], r["step"]): (r["p"], r["n"]) for r in table}
        if not at:
            break
        best: tuple[float, Condition] | None = None
        for name, (_, top) in GRIDS.items():
            p0, n0 = (sum(v[k] for (ratio, _), v in at.items() if ratio == name) for k in (0, 1))
            if not n0 or not p0:
                break
            p = n = 0
            for step in range(top):
                p, n = p + at.get((name, step), (0, 0))[0], n + at.get((name, step), (0, 0))[1]
                for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    worth = _gain(a, b, p0, n0)
                    if worth > 1e-9 and (best is None or worth > best[0] + 1e-9):
                        best = (worth, Condition(name, above, step))
        if best is None:
            break
        rule += (best[1],)
    return rule


def _pruned(rows: DataFrame, rule: Rule) -> tuple[Rule, float, int]:
    """The beginning of the rule that does best on the rows it didn't grow on, its share of bad ones among all rows, and how many it covers."""
    begun = [rule[: k + 1] for k in range(len(rule))]
    sums = [F.count_if(_covers(r) & kind & part).alias(f"{i}_{j}_{k}") for i, r in enumerate(begun) for j, kind in enumerate((F.col("bad"), ~F.col("bad"))) for k, part in enumerate((F.col("grows"), ~F.col("grows")))]
    got = rows.agg(*sums).first()
    score = lambda i: (got[f"{i}_0_1"] - got[f"{i}_1_1"]) / max(1, got[f"{i}_0_1"] + got[f"{i}_1_1"])
    i = max(range(len(begun)), key=lambda i: (score(i), -i))
    p, n = got[f"{i}_0_0"] + got[f"{i}_0_1"], got[f"{i}_1_0"] + got[f"{i}_1_1"]
    return begun[i], p / max(1, p + n), p + n


def learned(rows: DataFrame, most_rules: int = 8, most_conditions: int = 3, purity: float = 0.95, support: int = 3) -> list[Rule]:
    """The rules of bad documents, in the order in which they were found, from (bad, grows, steps) of `labelled`.

    A rule of which under `purity` of the covered rows are bad, or that covers fewer than `support`, ends the list: what no rule
    covers is kept. Without labels of both kinds there is no rule."""
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = rows.filter(~reduce(lambda a, b: a | b, map(_covers, rules), F.lit(False)))
        rule = _grown(left, most_conditions)
        if not rule:
            break
        rule, pure, covered = _pruned(left, rule)
        if pure < purity or covered < support:
            break
        rules.append(rule)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The place of the first rule that covers a row, from 1, and null where none does: one ordered conditional expression."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(_covers(rules[k - 1]), k).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **how) -> DataFrame:
    """Each row of `docs` (or its columns `keep`) as it is, in `row`, with its counts, base_failed, rule (the first that covers it), because (that rule in
    words) and kept.

    A null text is empty and fails the base rules, as do texts under 50 words; those teach nothing. Null ids have no label; repeated
    rows are judged alike and each counts; an empty table gives an empty one. Without labels only the base rules hold.
    Only doc_id and text, and of `labels` doc_id and quality, are read. A very long text is one row, whole."""
    counts = written(counted(docs, keep), "counts")
    known = written(labelled(counts, labels), "labelled", counts.rows)
    rules = learned(known, **how)
    release(known)
    because = F.lit(None).cast("string")
    for k, r in enumerate(rules, 1):
        because = F.when(F.col("rule") == k, " and ".join(map(str, r))).otherwise(because)
    own = counts.columns[2:]
    stepped = counts.select("row", "doc_id", *own, base_failed().alias("base_failed"), *steps().values())
    ruled = stepped.select("row", "doc_id", *own, "base_failed", F.when(~F.col("base_failed"), verdict(rules)).alias("rule"))
    return ruled.select("row", "doc_id", *own, "base_failed", "rule", because.alias("because"), (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def judged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of each document, without its text."""
    return judged(docs, labels, keep=["doc_id"]).drop("row")
