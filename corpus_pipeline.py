"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language, lines, packing, similar
from millrace.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def columns_of(docs: DataFrame) -> list[str]:
    """The columns of documents that the table has; further ones don't pass through."""
    return [c for c in COLUMNS if c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get the language that is found in their text; those without a letter, with a null or an empty text go. Where no
    language could be learned, the others keep the one they have. Repeated rows are judged alike, of equal scores the language
    that sorts first wins, very long texts are read whole. An empty table gives an empty one."""
    model = language.fit(docs)
    if not model.families:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*columns_of(docs))
    found = language.identify(docs, model)
    return found.filter(F.col("lang_pred") != "und").withColumn("lang", F.col("lang_pred")).select(*columns_of(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines go, and documents of which nothing is left; earlier is a smaller doc_id, null first, then
    the row's place in its file. A null text has no lines and stays, so does an empty one that lost nothing; of repeated rows
    the first keeps its lines. n_chars follows the text where it changed."""
    found = lines.dedup_lines(docs, min_chars=None)
    changed = F.col("n_removed") > 0
    found = found.filter(~changed | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return found.select(*columns_of(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest doc_id, null first. Linked are texts whose sets
    of five-word shingles have a similarity of 0.8 or more, computed for each pair that the SimHash tries or, where those can't
    reach, min-hashes propose. Null texts, empty ones and those without a word are equal to each other; repeated rows are copies."""
    return similar.without_similar(docs, width=5, least=0.8).select(*columns_of(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts hold none, and no document goes where the
    benchmark is empty. Repeated rows go or stay together."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*columns_of(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, with their ids. A null or empty text is one token, repeated rows
    are packed each; an empty table gives no piece."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]
#: SQL expresses neither the trained model nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
