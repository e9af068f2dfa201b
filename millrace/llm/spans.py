"""Substring deduplication by sliding sentence spans.

Hashed are the runs of consecutive sentences that are just long enough (at least two, and at least 20 words): the shortest
that begins at each sentence and the shortest that ends at each. The hashes meet in one global aggregate, and sentences
that lie in a run which occurred earlier are removed. Each sentence of a longer repeated passage is the first or the
last of such a run within it, so the passage is the union of them. A text in which no run is long enough is one run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW, joined_to_counted, numbered, release, written

#: A sentence ends with its stops and quotes before white space, at a line end, or at a row of three or more marks.
BREAK = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+|[。！？]|\n\s*|\s*[-#$%&*=~_|<>]{3,}\s*")
WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    """(from, to) of the sentences; together they are the whole text, each with what separates it from the next."""
    out, at = [], 0
    for m in BREAK.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def runs(text: str, least: int, words: int, ends: bool = True) -> tuple[list[int], list[int], list[int], list[int]]:
    """Shortest runs from each sentence, and with `ends` those to each sentence and a whole text that is shorter: first, count,
    64 and 32 bits of hash. Compared are the words alone, in lower case; sentences without a word belong to the run
    around them but don't count."""
    import xxhash

    said = []
    for k, (a, b) in enumerate(sentences(text)):
        found = WORD.findall(text[a:b].lower())
        if found:
            said.append((k, len(found), " ".join(found)))
    spans = []
    stop = total = 0
    for i in range(len(said)):
        if stop < i:
            stop, total = i, 0
        while stop < len(said) and (stop - i < least or total < words):
            total += said[stop][1]
            stop += 1
        if stop - i < least or total < words:
            break
        spans.append((i, stop))
        total -= said[i][1]
    if ends:
        i = total = 0
        for stop in range(1, len(said) + 1):
            total += said[stop - 1][1]
            while i < stop and stop - i - 1 >= least and total - said[i][1] >= words:
                total -= said[i][1]
                i += 1
            if stop - i >= least and total >= words:
                spans.append((i, stop))
        spans = sorted(set(spans)) or [(0, len(said))] * bool(said)
    first, count, high, low = [], [], [], []
    for i, stop in spans:
        digest = xxhash.xxh3_128_intdigest("\n".join(s for _, _, s in said[i:stop]).encode())
        first.append(said[i][0])
        count.append(said[stop - 1][0] - said[i][0] + 1)
        high.append((digest >> 64) - (1 << 63))
        low.append((digest & 0xFFFFFFFF) - (1 << 31))
    return first, count, high, low


def repeated_sentences(rows: DataFrame, least: int = 2, words: int = 20, ends: bool = True) -> DataFrame:
    """From doc_id, text and the row's identity: __row and `cover`, merged (first sentence, sentences) that an earlier run
    repeats. Earlier is a smaller (doc_id, row, sentence), null ids first. The texts are hashed once; the spans are a
    written table, of which hashes that are common are joined without a shuffle."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts, size = [], 0
            for doc, file, at, text in zip(frame["doc_id"], frame["file"], frame["at"], frame["text"], strict=True):
                if text:
                    parts.append((doc, file, at, *runs(text, least, words, ends)))
                    size += len(parts[-1][3])
                if size > 100_000:
                    yield pack(parts)
                    parts, size = [], 0
            yield pack(parts)

    def pack(parts: list[tuple]) -> pd.DataFrame:
        n = [len(p[3]) for p in parts]
        docs = pd.array([None if pd.isna(p[0]) else int(p[0]) for p in parts], dtype="Int64")
        each = lambda k: np.repeat(np.array([p[k] for p in parts], dtype=np.int64), n)
        cat = lambda k, kind: np.concatenate([np.zeros(0, dtype=kind), *[np.array(p[k], dtype=kind) for p in parts]])
        return pd.DataFrame({"doc_id": docs.repeat(n), "file": each(1), "at": each(2), "first": cat(3, "i4"), "n": cat(4, "i4"), "h1": cat(5, "i8"), "h2": cat(6, "i4")})

    texts = rows.select("doc_id", f"{ROW}.file", f"{ROW}.at", "text")
    spans = written(texts.mapInPandas(hashed, "doc_id bigint, file bigint, at bigint, first int, n int, h1 bigint, h2 int"), "spans")
    firsts = spans.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "file", "at", "first")).alias("source")).filter("times > 1")
    firsts = written(firsts.select("h1", "h2", "times", *[F.col(f"source.{c}").alias(f"source_{c}") for c in ("file", "at", "first")]), "first-spans")
    same = (F.col("file") == F.col("source_file")) & (F.col("at") == F.col("source_at")) & (F.col("first") == F.col("source_first"))
    later = joined_to_counted(spans.drop("doc_id"), firsts, ["h1", "h2"], spans.rows).filter(~same)
    later = later.select(F.struct("file", "at").alias(ROW), "first", (F.col("first") + F.col("n")).alias("stop"))
    along = Window.partitionBy(ROW).orderBy("first", "stop")
    reach = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("reach", reach).withColumn("piece", F.sum(F.when(F.col("first") <= F.col("reach"), 0).otherwise(1)).over(along))
    merged = later.groupBy(ROW, "piece").agg(F.min("first").alias("first"), F.max("stop").alias("stop"))
    cover = written(merged.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("first", "stop"))).alias("cover")), "covers")
    release(spans, firsts)
    return cover


def dedup_spans(docs: DataFrame, least: int = 2, words: int = 20, ends: bool = False) -> DataFrame:
    """All columns of `docs`, text without the sentences that an earlier run covers, with n_removed (sentences) and
    removed (from, to in code points of the given text, in order).

    Without `ends` only the shortest run from each sentence is looked up, so that the last sentences of a repeated passage
    may stay. The first occurrence stays, also within one document. Case, punctuation and spacing don't count. Runs of
    under `words` words or `least` sentences never repeat anything, unless they are the whole of both texts. Null texts stay null; a document made of
    repeats alone is left with an empty text. Repeated rows are repeats like any other; null ids come first. An
    empty table gives an empty result; columns named n_removed or removed are replaced,
    one named __row is left out.
    """
    rows = numbered(docs).drop("n_removed", "removed")
    cover = repeated_sentences(rows.select("doc_id", ROW, "text"), least, words, ends)

    @F.pandas_udf("text string, n_removed int, removed array<struct<start:int,stop:int>>")
    def cut(text: pd.Series, cover: pd.Series) -> pd.DataFrame:
        out = []
        for t, c in zip(text, cover, strict=True):
            if c is None:
                out.append((t, 0, []))
                continue
            parts, gone, kept, at, n = sentences(t), [], [], 0, 0
            for span in c:
                a, b = parts[span["first"]][0], parts[span["stop"] - 1][1]
                kept.append(t[at:a])
                gone.append({"start": a, "stop": b})
                at, n = b, n + span["stop"] - span["first"]
            out.append(("".join([*kept, t[at:]]), n, gone))
        return pd.DataFrame(out, columns=["text", "n_removed", "removed"])

    joined = rows.join(cover.hint("merge"), ROW, "left").withColumn("__cut", cut("text", "cover"))
    columns = [F.col("__cut.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in rows.columns if c != ROW]
    return joined.select(*columns, *[F.col(f"__cut.{c}").alias(c) for c in ("n_removed", "removed")])


def deduped_documents(docs: DataFrame) -> DataFrame:
    return dedup_spans(docs, ends=True).select("doc_id", "text", "n_removed", "removed")
