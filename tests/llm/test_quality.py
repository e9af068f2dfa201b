"""Quality rules: counts against a plain version, learning on planted conditions and on held-out documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import quality
from millrace.llm.common import table

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
SPACE = " \t\n\x0b\x0c\r"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_counts_equal_plain_version(spark, sf):
    texts = [None, "", " ", "a", "a a a a", "a b a b a b", "x y z x y z q", "a\n\na\n a\n\x0b\n", "é\U0001f600 # $|<>&*%", "\x1f a\xa0b", "a a\na a\n" * 40, "one two three " * 3, "A" * 70000, " ".join(map(str, range(30000))) + " 1 2 3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_words", F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert tuple(got[k][c] for c in COUNTS) == counts(t), t and t[:30]
        assert got[k].row.text == t and got[k].row.n_words == "clash" and got[k].rule is None and got[k].kept != got[k].base_failed
    real = table(spark, sf, "documents")
    found = {r.doc_id: r for r in quality.judged_documents(real, labels).collect()}
    assert all(tuple(found[r.doc_id][c] for c in COUNTS) == counts(r.text) for r in real.collect())


def plain_list(rules, r):
    """The first rule that holds, worked out from counts alone."""
    share = lambda a, b, name: min(quality.GRIDS[name][1], a * quality.GRIDS[name][0] // max(1, b))
    at = {"symbols_per_word": share(r.n_symbols, r.n_words, "symbols_per_word"), "capitals_per_char": share(r.n_capitals, r.word_chars, "capitals_per_char"), "digits_per_char": share(r.n_digits, r.word_chars, "digits_per_char"), "word_chars_per_word": share(r.word_chars, r.n_words, "word_chars_per_word"), "marks_per_word": share(r.n_marks, r.n_words, "marks_per_word"), "exclamations_per_word": share(r.n_exclamations, r.n_words, "exclamations_per_word"), "dup_lines_per_line": share(r.n_dup_lines, r.n_lines, "dup_lines_per_line"), "repeat_words_per_word": share(r.n_repeat_words, r.n_words, "repeat_words_per_word"), "distinct_words_per_word": share(r.n_distinct, r.n_words, "distinct_words_per_word"), "lines_per_word": share(r.n_lines, r.n_words, "lines_per_word")}
    at["log2_words"] = min(60, max(0, 2 * r.n_words.bit_length() - 2)) if r.n_words and r.n_words & (r.n_words - 1) == 0 else int(2 * math.log2(max(1, r.n_words)))
    for k, rule in enumerate(rules, 1):
        if all(at[c.ratio] > c.step if c.above else at[c.ratio] <= c.step for c in rule):
            return k
    return None


def test_rules_find_planted_conditions(spark):
    """Bad are texts with many digits, and texts with many symbols and few capitals; a tenth of the labels contradict each other."""
    def text(k, digits, symbols, capitals):
        rng = random.Random(k)
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60 + k % 50)]
        return " ".join(f"{w}{i if digits else ''}{'#' if symbols else ''}{'UVW' if capitals else ''}" for i, w in enumerate(words))

    rows, bad = [], {}
    for k in range(1200):
        digits, symbols, capitals = k % 5 == 0, k % 3 == 0, k % 2 == 0
        rows.append((k, text(k, digits, symbols, capitals)))
        bad[k] = digits or (symbols and not capitals)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    said = [(k, 1 - b, 0) for k, b in bad.items() if k % 4] + [(k, 1 - bad[k], 0) for k in range(0, 40)] + [(k, q, 0) for k in range(1, 400, 40) for q in (0, 1)] + [(None, 0, 0), (5000, None, 0)]
    labels = spark.createDataFrame(said, "doc_id bigint, quality int, toxic int")
    known = quality.labelled(quality.counted(docs), labels).cache()
    rules = quality.learned(known)
    assert 2 <= len(rules) <= 4 and {c.ratio for r in rules for c in r} <= set(quality.GRIDS)
    out = quality.judged_documents(docs, labels).collect()
    assert all(r.kept != bad[r.doc_id] for r in out)
    assert all(r.rule == plain_list(rules, r) for r in out)
    assert all((r.because is None) == r.kept for r in out)
    assert quality.learned(known.filter("bad")) == [] and quality.learned(known.filter("NOT bad")) == [] and quality.learned(known.limit(0)) == []


def test_rules_on_held_out_documents(spark):
    """Learned on the labels of two thirds of the documents, judged on the rest."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out = quality.judged_documents(docs, labels.filter(~held)).filter("NOT base_failed").join(labels.filter(held), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in out}
    assert n.get((1, False), 0) <= 0.01 * n[1, True], n
    assert n.get((0, True), 0) <= 0.3 * n[0, False], n


def test_quality_stays_native_and_handles_empty_tables(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    assert quality.judged_documents(docs.limit(0), labels).count() == 0
    plan = quality.labelled(quality.counted(docs), labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("quality_of", [0, 1])
def test_one_sided_labels_teach_nothing(spark, sf, quality_of):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    assert quality.judged_documents(docs, labels.filter(F.col("quality") == quality_of)).filter("kept = base_failed").count() == 0
