"""Languages of texts by profiles of character n-grams and a Bayes posterior over them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LONGEST = 3
#: Characters that are counted at a time, and entries of a table that is filled in full rather than searched.
PIECE, DENSE = 1 << 21, 1 << 22


@dataclass(frozen=True)
class Profiles:
    """For each language the logarithm of the probability of each known n-gram, and of one that it never showed."""

    names: tuple[str, ...]
    grams: dict[str, tuple[float, ...]]


def normal(text: Column) -> Column:
    """Lower-case letters, all else single blanks, one at each end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def keys_of(ids: np.ndarray, n: int, size: int) -> np.ndarray:
    """A number for each n-gram of `ids`, which lie under `size`."""
    keys = ids[: max(0, len(ids) - n + 1)].astype(np.int64)
    for k in range(1, n):
        keys = keys * size + ids[k : len(ids) - n + 1 + k]
    return keys


def counted_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of texts (lang, t), of one language up to PIECE characters at a time. A blank is no gram by itself."""

    def counted(lang: str, texts: list[str]) -> pa.RecordBatch:
        codes = codes_of("\0" + "\0".join(texts))  # no gram reaches over a zero
        letters = np.flatnonzero(np.bincount(codes))
        place = np.zeros(int(letters[-1]) + 1, np.int64)
        place[letters] = np.arange(len(letters))
        ids, size, grams, times = place[codes], len(letters), [], []
        for n in range(1, LONGEST + 1):
            keys = keys_of(ids, n, size)
            if size**n <= DENSE:
                counts = np.bincount(keys, minlength=1)
                found = np.flatnonzero(counts)
                counts = counts[found]
            else:
                found, counts = np.unique(keys, return_counts=True)
            parts = [letters[found // size ** (n - 1 - k) % size] for k in range(n)]
            whole = np.all([p > 0 for p in parts], axis=0)
            grams += ["".join(map(chr, g)) for g in zip(*(p[whole].tolist() for p in parts), strict=True)]
            times += counts[whole].tolist()
        kept = [(g, t) for g, t in zip(grams, times, strict=True) if g != " "]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(kept), pa.string()), pa.array([g for g, _ in kept], pa.string()), pa.array([t for _, t in kept], pa.int64())], ["lang", "gram", "n"])

    waiting: dict[str, list[str]] = {}
    sizes: Counter[str] = Counter()
    for batch in batches:
        for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            waiting.setdefault(lang, []).append(t)
            sizes[lang] += len(t)
            if sizes[lang] >= PIECE or sum(sizes.values()) >= 4 * PIECE:
                lang = max(sizes, key=sizes.__getitem__)
                yield counted(lang, waiting.pop(lang))
                del sizes[lang]
    for lang, texts in waiting.items():
        yield counted(lang, texts)


def learned_profiles(texts: DataFrame, text: str = "text", language: str = "lang", most: int = 1000) -> Profiles:
    """Profiles of the languages that `texts` names: the `most` frequent n-grams of each, of one to three characters.

    Counts are made by pieces of texts before the shuffle, and only the profiles, of `most` rows a language, come to the driver."""
    known = texts.filter(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).cast("string").alias("lang"), normal(F.col(text)).alias("t"))
    grams = known.mapInArrow(counted_grams, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = grams.withColumn("rank", rank).filter(F.col("rank") <= most).select("lang", "gram", "n").collect()
    names = tuple(sorted({r["lang"] for r in top}))
    total = {x: sum(r["n"] for r in top if r["lang"] == x) for x in names}
    seen = {(r["lang"], r["gram"]): r["n"] for r in top}
    odds = lambda x, g: log((seen.get((x, g), 0) + 0.5) / (total[x] + 0.5 * most))
    return Profiles(names, {g: tuple(odds(x, g) for x in names) for g in sorted({r["gram"] for r in top})})


def most_likely(text: str | None, known: Profiles) -> str | None:
    """The language of the highest posterior, all being equally likely before; null for a text without a known n-gram."""
    return Teller(known).told(" " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " ")


class Teller:
    """Profiles as tables: a letter's number, and by the numbers of an n-gram its place among the known ones."""

    def __init__(self, known: Profiles) -> None:
        self.names = known.names
        letters = sorted({c for g in known.grams for c in g})
        self.size = len(letters) + 1
        self.place = np.zeros(0x110000, np.int32)  # 0: a letter of no known n-gram
        for i, c in enumerate(letters, 1):
            self.place[ord(c)] = i
        self.tables = []
        for n in range(1, LONGEST + 1):
            grams = [g for g in known.grams if len(g) == n]
            keys = np.array([keys_of(self.place[codes_of(g)], n, self.size)[0] for g in grams], np.int64)
            order = np.argsort(keys)
            odds = np.array([known.grams[grams[i]] for i in order]).reshape(len(grams), len(self.names))
            dense = None
            if self.size**n <= DENSE:
                dense = np.full(self.size**n, len(grams), np.int32)
                dense[keys[order]] = np.arange(len(grams))
            self.tables.append((keys[order], odds, dense))

    def told(self, normal: str) -> str | None:
        ids = self.place[codes_of(normal)]
        sums, met = np.zeros(len(self.names)), False
        for n, (known, odds, dense) in enumerate(self.tables, 1):
            keys = keys_of(ids, n, self.size)
            if not len(keys) or not len(known):
                continue
            if dense is not None:
                at = dense[keys]
            else:
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                at = np.where(known[at] == keys, at, len(known))
            times = np.bincount(at, minlength=len(known) + 1)[: len(known)]
            met = met or bool(times.any())
            sums += times @ odds
        return self.names[int(np.argmax(sums))] if met else None


def likely_language(text: Column, known: Profiles) -> Column:
    @F.pandas_udf("string")
    def told(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        teller = Teller(known)
        for t in texts:
            yield t.map(teller.told)

    return told(normal(F.coalesce(text, F.lit(""))))
