"""Sampling, mixture, holdout and top-k. Draws are keyed hashes: deterministic, different for each epoch or seed, and
made without a driver; they keep the contract of a seeded shuffle, not its order."""

from __future__ import annotations

from functools import reduce
from math import gcd, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut
from .ranking import PART, numbered_by


def keyed_hash(*key: Column | str, seed: int) -> Column:
    """60 bits of the MD5 of seed and key, joined by colons, as a number."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def draw(*key: Column | str, seed: int) -> Column:
    """In [0, 1)."""
    return keyed_hash(*key, seed=seed) / float(1 << 60)


def epoch_order(df: DataFrame, position: str, seed: int, epoch: int) -> DataFrame:
    """`df` in the order of one epoch, with `epoch_pos` from 0."""
    keyed = df.withColumn("__key", keyed_hash(position, seed=seed + epoch))
    keyed = keyed.withColumn(PART, F.shiftright("__key", 48))  # hashes are even, so their leading bits are ranges of equal counts
    return numbered_by(keyed, "epoch_pos", "__key", [position]).drop("__key", PART)


def fanned_out(df: DataFrame, position: str, copies: int) -> DataFrame:
    """`copies` rows of each prompt: group_index, index."""
    g = F.col(position)
    return df.withColumn("group_index", g).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("index", g * copies + F.col("copy"))


def chosen_source(weights: dict[str, float], u: Column) -> Column:
    """The source whose share of the cumulative weights holds `u`."""
    total, upto, out = sum(weights.values()), 0.0, None
    names = [k for k, w in weights.items() if w > 0]
    for name in names[:-1]:
        upto += weights[name] / total
        out = (F.when if out is None else out.when)(u < upto, F.lit(name))
    return F.lit(names[-1]) if out is None else out.otherwise(F.lit(names[-1]))


def stratified_slots(weights: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """(source, slots) from (source, weight): one slot for each source of positive weight, then floors of the shares, then
    largest remainders, ties by keyed hash. Fewer slots than sources are an error. One row for each source."""
    w = weights.filter("weight > 0")
    total = w.agg(F.sum("weight").alias("total"), F.count("*").alias("sources"))
    some = F.when(F.col("sources") <= count, count - F.col("sources")).otherwise(F.raise_error(F.lit("fewer slots than sources")).cast("bigint"))
    w = w.join(F.broadcast(total)).withColumn("exact", some * F.col("weight") / F.col("total")).withColumn("sure", F.floor("exact"))
    left = F.broadcast(w.agg((F.first("sources") + F.sum("sure")).alias("given")))
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("exact") - F.col("sure"), 12)), keyed_hash("source", seed=seed)))
    return w.withColumn("turn", turn).join(left).select("source", (1 + F.col("sure") + (F.col("turn") <= count - F.col("given")).cast("int")).cast("int").alias("slots"))


def stride_sample(df: DataFrame, position: str, rows: int, start: int, stride: int, count: int) -> DataFrame:
    """`df` and `pick`, for the rows at the positions (start + i * stride) mod `rows`, i < `count`; the stride is raised
    to the next that shares no factor with `rows`, so no position comes twice. A filter alone: i is solved for."""
    while rows > 1 and gcd(stride, rows) != 1:
        stride += 1
    turn = F.pmod((F.col(position) - start) * pow(stride, -1, rows) if rows > 1 else F.lit(0), F.lit(max(rows, 1)))
    return df.withColumn("pick", turn).filter(F.col("pick") < count)


def curriculum(phases: list[tuple[str, int]], position: Column, repeat: bool = False) -> Column:
    """Source of each request by cumulative phase sizes; beyond the last an error unless phases repeat."""
    total = sum(n for _, n in phases)
    at, upto, out = F.pmod(position, F.lit(total)) if repeat else position, 0, None
    for name, n in phases:
        upto += n
        out = (F.when if out is None else out.when)(at < upto, F.lit(name))
    return out.otherwise(F.raise_error(F.lit("the curriculum is exhausted")).cast("string"))


def source_cursor(requests: DataFrame, source: str, order: str, lengths: DataFrame) -> DataFrame:
    """Each request's epoch and position within its source; `lengths` has (source, length)."""
    numbered = numbered_by(requests, "__n", order, within=[source]).join(lengths.select(F.col("source").alias(source), F.col("length").alias("__size")), source)
    return numbered.withColumn("epoch", F.floor(F.col("__n") / F.col("__size"))).withColumn("position", F.pmod("__n", "__size")).drop("__n", "__size")


def source_prompts(requests: DataFrame, source: str, order: str, prompts: DataFrame, prompt: str, seed: int, shuffle: bool = True, strict: bool = False) -> DataFrame:
    """`requests` with their epoch, their position in it and the `prompt` that stands there, of `prompts` (`source`, `prompt`).

    Each source goes through its prompts in an order of its own, the first time as they are, or with `shuffle` by a hash with the seed
    and the epoch, anew for each. When a source has given all, its next epoch begins; with `strict` that is an error. Requests
    of sources without prompts go. Prompts are numbered for the epochs that are asked for, within ranges of their order."""
    lengths = prompts.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("length"))
    asked = source_cursor(requests, source, order, lengths)
    if strict:
        asked = asked.withColumn("epoch", F.when(F.col("epoch") > 0, F.raise_error(F.concat(F.lit("all prompts of "), F.col(source).cast("string"), F.lit(" were given"))).cast("bigint")).otherwise(F.col("epoch")))
    asked = cut(asked)
    epochs = asked.select(source, "epoch").distinct()
    turn = F.md5(F.concat_ws(":", (F.lit(seed) + F.col("epoch")).cast("string"), F.col(prompt).cast("string"))) if shuffle else F.lit("")
    dealt = numbered_by(prompts.select(source, prompt).join(epochs, source).withColumn("__turn", turn), "position", "__turn", [prompt], [source, "epoch"]).drop("__turn")
    return asked.join(dealt, [source, "epoch", "position"])


def balanced_subset(df: DataFrame, stratum: str, key: str, count: int, seed: int) -> DataFrame:
    """`count` rows, taken in turn from each stratum in hash order."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(keyed_hash(key, seed=seed), key))
    first = df.withColumn("__turn", turn).filter(F.col("__turn") <= count)  # limits each stratum before the shuffle
    return first.orderBy("__turn", stratum).limit(count).drop("__turn")


def holdout(df: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """`df` with `held_out`: the rows of the smallest hashes, min(count, rows - 1) of them, ties by key. The cut is
    found by a bounded top-k, so no total order of the table is made."""
    h = keyed_hash(key, seed=seed)
    n = df.count()
    k = max(0, min(count, n - 1))
    if k == 0:
        return df.withColumn("held_out", F.lit(False))
    last = df.select(h.alias("h"), F.col(key).alias("k")).orderBy("h", "k").limit(k).agg(F.max(F.struct("h", "k")).alias("m")).first()["m"]
    return df.withColumn("held_out", (h < last["h"]) | ((h == last["h"]) & (F.col(key) <= last["k"])))


def sliced(df: DataFrame, position: str, start: int | None, stop: int | None) -> DataFrame:
    """Rows [start:stop] by position, negative bounds from the end; an over-long negative bound is the start."""
    n = df.count() if (start or 0) < 0 or (stop or 0) < 0 else 0
    at = lambda b: max(0, n + b) if b < 0 else b
    out = df
    if start is not None:
        out = out.filter(F.col(position) >= at(start))
    return out.filter(F.col(position) < at(stop)) if stop is not None else out


def head_and_tail(df: DataFrame, position: str, ratio: float) -> DataFrame:
    """int(n * ratio) rows, the first half from the head and the rest, one more if odd, from the tail; all rows if
    that number is 0."""
    n = df.count()
    k = int(n * ratio)
    return df if k == 0 else df.filter((F.col(position) < k // 2) | (F.col(position) >= n - (k + 1) // 2))


def one_standard_error(df: DataFrame, value: str, mean: str, se: str) -> DataFrame:
    """The smallest value whose mean is within one combined standard error of the best."""
    best = df.agg(F.max_by(F.struct(mean, se), mean).alias("b"))  # one row
    near = df.join(F.broadcast(best)).filter(F.col(mean) >= F.col(f"b.{mean}") - F.sqrt(F.col(f"b.{se}") ** 2 + F.col(se) ** 2))
    return near.agg(F.min(value).alias("selected"))


def dense_top_k(queries: DataFrame, docs: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """Exact inner-product top-k of a stated query set (query_id, vector) against all rows. One block of queries at a time is
    sent, and its answers, at most k for each query and partition, are written before the next one is."""
    import numpy as np
    import pandas as pd

    spark, found = docs.sparkSession, []
    none = spark.createDataFrame([], "query_id bigint, doc_id bigint, score double, rank int")
    docs = docs.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    queries = queries.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    rows = queries.orderBy("query_id").toLocalIterator()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    while some := [r for _, r in zip(range(block), rows)]:
        ids, matrix = np.array([r["query_id"] for r in some]), np.array([r["vector"] for r in some], dtype=float)
        sent = spark.sparkContext.broadcast((ids, matrix))
        best = docs.select("doc_id", "vector").mapInPandas(_partial_top_k(sent, k, np, pd), "query_id bigint, doc_id bigint, score double")
        found.append(cut(best.withColumn("rank", rank).filter(F.col("rank") <= k)))
        sent.destroy()
    return reduce(DataFrame.unionByName, found, none)


def _partial_top_k(sent, k, np, pd):
    def best(frames):
        ids, matrix = sent.value
        for f in frames:
            if len(f):
                score, doc = matrix @ np.stack(f["vector"].to_numpy()).astype(float).T, f["doc_id"].to_numpy()
                few = min(k, len(doc))
                least = np.partition(score, len(doc) - few, axis=1)[:, len(doc) - few]  # ties at the k-th place stay
                q, at = np.nonzero(score >= least[:, None])
                yield pd.DataFrame({"query_id": ids[q], "doc_id": doc[at], "score": score[q, at]})

    return best


def bm25_top_k(queries: DataFrame, docs: DataFrame, k: int, k1: float = 0.9, b: float = 0.4, block: int = 1024) -> DataFrame:
    """(query_id, text) against (doc_id, text): the sum over common words of idf * tf / (tf + k1 * (1 - b + b * length / mean)), words
    lower-cased, rounded to nine places to rank; ties to the smaller doc_id. Null texts have no word.

    Texts are read twice: for how many documents hold each word of the queries, of which a task sends one row a word, and for the scores,
    of which a task sends its best `k` of each query, with ties. So neither words of documents nor pairs are shuffled. Each
    `block` queries, which are broadcast, take one reading of their own."""
    spark = docs.sparkSession
    text = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    asked = queries.filter(F.col("text").isNotNull()).select("query_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("words"))
    found, rows = [], asked.orderBy("query_id").toLocalIterator()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    while some := [r for _, r in zip(range(block), rows)]:
        vocabulary = {w: i for i, w in enumerate(sorted({w for r in some for w in r["words"]}))}
        sent = spark.sparkContext.broadcast(([r["query_id"] for r in some], [[vocabulary[w] for w in r["words"]] for r in some], vocabulary))
        counts = text.mapInPandas(_document_counts(sent), "word int, n bigint, words bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()  # a row a word
        whole = next((r for r in counts if r["word"] == -1), None)
        if whole is not None and whole["words"] and vocabulary:
            held = {r["word"]: r["n"] for r in counts}
            idf = [log(1 + (whole["n"] - held.get(i, 0) + 0.5) / (held.get(i, 0) + 0.5)) for i in range(len(vocabulary))]
            best = text.mapInPandas(_best_documents(sent, idf, whole["words"] / whole["n"], k, k1, b), "query_id bigint, doc_id bigint, score double")
            found.append(cut(best.withColumn("rank", rank).filter(F.col("rank") <= k)))
        sent.destroy()
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], "query_id bigint, doc_id bigint, score double, rank int"))


def _document_counts(sent):
    """Of a task: for each word of the queries how many documents hold it, and under -1 the documents with words and all their words."""
    import re

    import pandas as pd

    def count(frames):
        vocabulary, held = sent.value[2], {}
        docs = words = 0
        for f in frames:
            for t in f["text"]:
                said = re.findall(r"\w+", t)
                docs, words = docs + bool(said), words + len(said)
                for w in set(said) & vocabulary.keys():
                    held[vocabulary[w]] = held.get(vocabulary[w], 0) + 1
        yield pd.DataFrame({"word": [-1, *held], "n": [docs, *held.values()], "words": [words] + [0] * len(held)})

    return count


def _best_documents(sent, idf: list[float], mean: float, k: int, k1: float, b: float):
    """Of each batch of a task: the best `k` documents of each query, and what ties with the last of them."""
    import re

    import numpy as np
    import pandas as pd

    def best(frames):
        ids, asked, vocabulary = sent.value
        ids = np.array(ids)
        # For each word the queries that ask for it, one after the other.
        pairs = np.array([(w, q) for q, ws in enumerate(asked) for w in ws], dtype=np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        query, upto = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(vocabulary) + 1))
        for f in frames:
            for at in range(0, len(f), 512):
                part = f.iloc[at : at + 512]
                score = np.zeros((len(part), len(ids)))
                for d, t in enumerate(part["text"]):
                    said, tf = re.findall(r"\w+", t), {}
                    for w in said:
                        if (i := vocabulary.get(w)) is not None:
                            tf[i] = tf.get(i, 0) + 1
                    for i, n in tf.items():
                        score[d, query[upto[i] : upto[i + 1]]] += idf[i] * n / (n + k1 * (1 - b + b * len(said) / mean))
                shown = np.round(score, 9)
                few = min(k, len(part))
                least = np.partition(shown, len(part) - few, axis=0)[len(part) - few]
                d, q = np.nonzero((shown >= least) & (score > 0))
                yield pd.DataFrame({"query_id": ids[q], "doc_id": part["doc_id"].to_numpy()[d], "score": score[d, q]})

    return best
