"""Language identification in two levels: the language family first, then one-versus-one linear support
vector machines among the closely related languages of that family.

Features are hashed counts of byte pairs and triples of the whole lower-cased text, damped and
normalised. The machines are fitted by gradient descent on the squared hinge loss over a bounded sample of
labelled rows; everything else runs over all rows in Spark tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of common languages; any other code is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indo-aryan": ["bn", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["am", "ar", "he"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
BITS = 12


def features(text: str) -> np.ndarray:
    """Unit vector of damped hashed counts; zero for a text of under two bytes."""
    u = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    out = np.zeros(1 << BITS)
    for at in range(0, len(u), 1 << 16):  # bounded blocks that overlap by two bytes
        b = u[at : at + (1 << 16) + 2]
        pair = (b[:-1] << 8) | b[1:]
        out += np.bincount((pair * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
        triple = (pair[:-1] << 8) | b[2:]
        out += np.bincount((triple * np.uint32(2246822519)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    out = np.log1p(out)
    norm = np.sqrt(out @ out)
    return out / norm if norm else out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit_machine(x: np.ndarray, positive: np.ndarray, taking: np.ndarray | None = None, rounds: int = 120, c: float = 20.0) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine on the rows of `x` that `taking` marks: squared hinge with Nesterov's
    momentum. Both sides weigh the same whatever their numbers. `x` is read where it lies, never copied."""
    taking = np.ones(len(x), bool) if taking is None else taking
    y = np.where(positive, 1.0, -1.0)
    weight = np.where(positive, 0.5 / max(1, (positive & taking).sum()), 0.5 / max(1, (~positive & taking).sum())) * taking
    w = v = np.zeros(x.shape[1] + 1)
    step = 1 / (1 + 4 * c)
    for t in range(rounds):
        short = np.maximum(0, 1 - y * (x @ v[:-1].astype(x.dtype) + v[-1]))
        pull = weight * y * short
        new = v - step * (v - 2 * c * np.append(pull.astype(x.dtype) @ x, pull.sum()))
        v, w = new + t / (t + 3) * (new - w), new
    return w


class Contest:
    """One-versus-one machines among `names`, on the rows of `x` that carry one of them; a share of votes for each, by squashed margins."""

    def __init__(self, x: np.ndarray, label: np.ndarray, names: list[str]):
        self.names = names
        self.pairs = list(combinations(range(len(names)), 2))
        self.w = [fit_machine(x, label == names[i], (label == names[i]) | (label == names[j])) for i, j in self.pairs]

    def shares(self, x: np.ndarray) -> np.ndarray:
        if len(self.names) == 1:
            return np.ones((len(x), 1))
        votes = np.zeros((len(x), len(self.names)))
        for (i, j), w in zip(self.pairs, self.w, strict=True):
            p = 1 / (1 + np.exp(-4 * (x @ w[:-1] + w[-1])))
            votes[:, i] += p
            votes[:, j] += 1 - p
        return votes / len(self.pairs)


class LanguageModel:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        family = np.array([FAMILY_OF.get(lang, lang) for lang in langs], dtype=object)
        self.families = sorted(set(family))
        self.outer = Contest(x, family, self.families) if self.families else None
        self.inner = {f: Contest(x, langs, sorted(set(langs[family == f]))) for f in self.families}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        outer = self.outer.shares(x)
        pick, lang, score = outer.argmax(axis=1), [""] * len(x), np.zeros(len(x))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(pick == k)
            if len(rows):
                inner = self.inner[f].shares(x[rows])
                best = inner.argmax(axis=1)
                score[rows] = outer[rows, k] * inner.max(axis=1)
                for r, b in zip(rows, best, strict=True):
                    lang[r] = self.inner[f].names[b]
        return lang, np.clip(score, 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = 500) -> LanguageModel:
    """Learns from about `per_language` rows of each language (the smallest keyed hashes; 1.5 times as many at
    most), of those that aren't held out and have a language, a letter and an id."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel(np.zeros((0, 1 << BITS)), np.array([], dtype=object))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit(8), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    schema = "lang string, f binary"

    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"lang": frame["lang"], "f": [zlib.compress(features(t).astype("<f4").tobytes(), 1) for t in frame["text"]]})

    # Vectors travel and wait compressed, since the driver's JVM holds all of them at once, several times over.
    # Repeated rows share their draw; one of them is enough, so what is drawn doesn't depend on the order of tasks.
    drawn = known.filter(draw < share[F.col("lang")]).groupBy(draw.alias("draw"), "lang").agg(F.min("text").alias("text"))
    rows = drawn.select("lang", "text").mapInPandas(featured, schema)
    got = sorted(map(tuple, rows.limit(int(1.5 * per_language * len(counts)) + 100).collect()))
    langs, x = np.array([lang for lang, _ in got], dtype=object), np.zeros((len(got), 1 << BITS), dtype="<f4")
    for k, (_, f) in enumerate(got):
        x[k] = np.frombuffer(zlib.decompress(f), dtype="<f4")
        got[k] = None  # each vector is held once
    for lang in counts:  # in the order of the vectors themselves
        own = np.flatnonzero(langs == lang)
        x[own] = x[sorted(own, key=lambda k: x[k].tobytes())]
    return LanguageModel(x, langs)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of `docs` with lang_pred and score (0 to 1), from whole texts alone.

    A null text, or one without a letter, is `und` with score 0, as is every text when nothing could be learned.
    Ties go to the language that sorts first. Rows keep their columns; lang_pred and score are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        m, lang, score = sent.value, np.array(["und"] * len(text), dtype=object), np.zeros(len(text))
        rows = [i for i, t in enumerate(text) if t is not None and has_letter(t)] if m.outer else []
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            lang[some], score[some] = m.predict(np.array([features(text.iloc[i]) for i in some]))
        return pd.DataFrame({"lang_pred": lang, "score": score})

    kept = docs.drop("lang_pred", "score")
    inner = [f"`{c}`" for c in kept.columns]
    return kept.withColumn("__said", predict("text")).select(*inner, F.col("__said.lang_pred").alias("lang_pred"), F.col("__said.score").alias("score"))


def identified_documents(docs: DataFrame) -> DataFrame:
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
