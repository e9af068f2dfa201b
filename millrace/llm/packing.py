"""Packing of tokenised documents into sequences of a fixed window, planned by non-negative least squares.

Documents are cut at multiples of the window; what is left of each is shorter than the window. The plan
works on the histogram of those lengths alone: enumerate the combinations of one to three lengths that fill
the window, solve for their repeat counts by non-negative least squares, round down, fill greedily with the
rest, and lay what still has no partner head to tail, cut at the window. The plan's size depends on the
window only, never on the number of documents; pieces find their place by their rank among equal lengths.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Entries that a worker keeps of its table of white-space separated chunks; beyond, chunks are encoded each time.
CHUNKS = 500_000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Byte-level BPE ids of whole texts, as bytes of little-endian unsigned 16-bit numbers.

    Pre-tokens never span a single white-space character that stands between other characters, so a text is
    split at spaces and line ends and each chunk is encoded once. `ranks` is the same vocabulary as `model`,
    in the form that is quicker for short chunks; texts with runs of white space are encoded in one go, those
    that spell out a special token by `model` itself, which gives its id."""

    def __init__(self, model: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(model)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(k): int(v) for k, v in (line.split() for line in f)}
        self.plain = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.runs = re.compile(r"\s\s")
        self.first, self.later = {}, {}
        self.newline = self.bytes(self.plain.encode_ordinary("\n"))

    @staticmethod
    def bytes(ids: list[int]) -> bytes:
        return np.asarray(ids, dtype="<u2").tobytes()

    def chunk(self, kept: dict[str, bytes], chunk: str, lead: str) -> bytes:
        found = kept.get(chunk)
        if found is None:
            found = self.bytes(self.plain.encode_ordinary(lead + chunk))
            if len(kept) < CHUNKS and len(chunk) < 64:
                kept[chunk] = found
        return found

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.bytes(self.model.encode(text, add_special_tokens=False).ids)
        if self.runs.search(text):
            return self.bytes(self.plain.encode_ordinary(text))
        later, chunk, out = self.later, self.chunk, []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                out.append(self.newline)
            out.append(chunk(self.first, words[0], ""))
            got = list(map(later.get, words[1:]))
            if None in got:
                got = [chunk(later, w, " ") if g is None else g for w, g in zip(words[1:], got, strict=True)]
            out += got
        return b"".join(out)


def plan(histogram: dict[int, int], window: int, slack: int = 8, rounds: int = 300) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns (length, times) with their repeat counts. No length is used more often than it occurs;
    what the patterns leave over belongs to the tail, which is laid head to tail."""
    left = np.zeros(window + 1, dtype=np.int64)
    for n, count in histogram.items():
        left[n] = count
    out: list[tuple[list[tuple[int, int]], int]] = []

    def use(lengths: list[int], times: int) -> None:
        each = {n: lengths.count(n) for n in set(lengths)}
        times = min([times, *(int(left[n]) // m for n, m in each.items())])
        if times > 0:
            out.append((sorted(each.items(), reverse=True), times))
            for n, m in each.items():
                left[n] -= m * times

    use([window], int(left[window]))
    have = np.flatnonzero(left)
    if len(have):
        combos = combinations(have, window)
        if len(combos):
            x = nnls(combos, left.astype(float), rounds)
            for k in np.argsort(-x, kind="stable"):
                if x[k] < 1:
                    break
                use([int(n) for n in combos[k] if n], int(x[k]))
    for n in range(window - 1, 0, -1):  # greedily: the longest left, then what fits best beside it
        while left[n]:
            fill, room, taken = [n], window - n, {n: 1}
            while room > slack:
                fits = [m for m in np.flatnonzero(left[: room + 1])[::-1][:64] if left[m] > taken.get(int(m), 0)]
                if not fits:
                    break
                fill.append(int(fits[0]))
                taken[int(fits[0])] = taken.get(int(fits[0]), 0) + 1
                room -= int(fits[0])
            if room > slack:
                break
            use(fill, int(left[n]))
    return out


def combinations(have: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths out of `have` (0: none) that sum to the window, each once, in falling order."""
    there = np.zeros(window + 1, dtype=bool)
    there[have] = True
    there[0] = True
    a, b = np.meshgrid(have, np.concatenate([[0], have]), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = window - a - b
    ok = (c >= 0) & (b >= c) & (a >= b)
    a, b, c = a[ok], b[ok], c[ok]
    ok = there[c]
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def nnls(combos: np.ndarray, target: np.ndarray, rounds: int) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |Ax - target|, A counting each length in each combination:
    accelerated projected gradients. Length 0 stands for an empty place and has no weight."""
    goal = target.copy()
    goal[0] = 0
    x = np.zeros(len(combos))
    degree = np.bincount(combos.ravel(), minlength=len(goal))
    degree[0] = 0
    step = 1 / max(1.0, 3.0 * degree.max())
    y, t = x, 1.0
    for _ in range(rounds):
        made = sum(np.bincount(combos[:, j], weights=y, minlength=len(goal)) for j in range(3))
        gap = made - goal
        gap[0] = 0
        new = np.maximum(0, y - step * gap[combos].sum(axis=1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


class Places:
    """Where the piece with a given length and rank goes, by the plan."""

    def __init__(self, patterns: list[tuple[list[tuple[int, int]], int]], window: int):
        used, rows, base = np.zeros(window + 1, dtype=np.int64), [], 0
        for lengths, times in patterns:
            offset = 0
            for n, m in lengths:
                rows.append((n, used[n], base, offset, m))
                used[n] += m * times
                offset += n * m
            base += times
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.length, self.start, self.base, self.offset, self.times = table.T
        self.keys = self.length * (1 << 45) + self.start
        self.used, self.sequences = used, base

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.keys, length * (1 << 45) + rank, side="right") - 1
        ahead = rank - self.start[k]
        return self.base[k] + ahead // self.times[k], self.offset[k] + ahead % self.times[k] * length


def tokenised_pieces(docs: DataFrame, window: int, model: str, ranks: str, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (16-bit), ids_crc32 (of 32-bit ids), and the piece's partition
    and rank among pieces of its length there; written, so that ranks stay."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        from pyspark import TaskContext

        encoder, end, part, seen = Encoder(model, ranks), np.array([end_id], dtype="<u2").tobytes(), TaskContext.get().partitionId(), {}
        size = 2 * window
        for frame in frames:
            out, held = [], 0
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = (encoder(text) if text else b"") + end
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    n = len(piece) // 2
                    seen[n] = rank = seen.get(n, -1) + 1
                    crc = zlib.crc32(np.frombuffer(piece, dtype="<u2").astype("<u4").tobytes())
                    out.append((doc, at // 2, n, len(ids) // 2, piece, crc, part, rank))
                    held += len(piece)
                if held > 1 << 23:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    schema = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, ids_crc32 bigint, part int, rank bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def typed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in encode(frames):
            yield frame.astype({"doc_id": "Int64"})

    return written(docs.select("doc_id", "text").mapInPandas(typed, schema), "pieces")


def pack(docs: DataFrame, window: int = 1024, model: str | None = None, ranks: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of `docs` (doc_id, text) in sequences of at most `window` tokens.

    doc_id, start, length, ids (16-bit little-endian, unless with_ids is false), ids_crc32, doc_tokens,
    sequence_id, offset. Each document is its text's ids and then id 0; a null or empty text is id 0 alone. Null
    or repeated ids and repeated rows are packed like any other: every row's tokens occur once. An empty table
    gives an empty result; further columns are ignored. Cuts fall at multiples of the window and, for the few
    pieces without partners, where a sequence is full; only the very last sequence can be left short by more than
    the slack of the plan.
    """
    spark = docs.sparkSession
    pieces = tokenised_pieces(docs, window, model or public_path("byte_bpe_50k.json"), ranks or public_path("byte_bpe_50k.tiktoken"))
    counts = written(pieces.groupBy("part", "length").count(), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = Places(plan(histogram, window), window)
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ranked_before"))
    sent = spark.sparkContext.broadcast(places)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, off = sent.value(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    def crc(ids: pd.Series, at: pd.Series, n: pd.Series) -> pd.Series:
        import zlib

        return pd.Series(
            [zlib.crc32(np.frombuffer(b, dtype="<u2")[i : i + m].astype("<u4").tobytes()) for b, i, m in zip(ids, at, n, strict=True)],
            dtype="int64",
        )

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.join(starts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("ranked_before"))

    planned = {n: int(places.used[n]) for n in histogram}
    tail, at = {}, 0  # where the stream of unplanned pieces holds those of each length
    for n in sorted(histogram, reverse=True):
        if histogram[n] > planned[n]:
            tail[n] = at
            at += n * (histogram[n] - planned[n])
    ids = ["ids"] if with_ids else []
    taken = F.create_map(*[F.lit(x) for kv in planned.items() for x in kv]) if planned else None
    columns = ["doc_id", "start", "length", *ids, "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = pieces.select("doc_id", "start", "length", "doc_tokens", *ids, "ids_crc32", "part", "rank")
    if taken is None:
        return whole.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).select(*columns)
    fixed = ranked(whole).filter(F.col("rank") < taken[F.col("length")]).withColumn("place", place("length", "rank"))
    fixed = fixed.withColumns({"sequence_id": F.col("place.sequence_id"), "offset": F.col("place.offset")}).select(*columns)
    if not tail:
        return fixed
    begin = F.create_map(*[F.lit(x) for kv in tail.items() for x in kv])[F.col("length")]
    loose = ranked(pieces.filter(F.col("length").isin(list(tail)))).filter(F.col("rank") >= taken[F.col("length")])
    loose = loose.withColumn("pos", begin + (F.col("rank") - taken[F.col("length")]) * F.col("length"))
    room = F.lit(window) - F.pmod("pos", F.lit(window))
    cut = F.least("length", room)
    parts = F.array(
        F.struct(F.lit(0).cast("bigint").alias("skip"), cut.alias("n")), F.struct(cut.alias("skip"), (F.col("length") - cut).alias("n"))
    )
    loose = loose.withColumn("cut", F.explode(F.filter(parts, lambda x: x["n"] > 0))).withColumn("pos", F.col("pos") + F.col("cut.skip"))
    loose = loose.select(
        "doc_id",
        (F.col("start") + F.col("cut.skip")).alias("start"),
        F.col("cut.n").alias("length"),
        *[F.expr("substring(ids, cast(2 * cut.skip + 1 as int), cast(2 * cut.n as int))").alias(x) for x in ids],
        F.pandas_udf(crc, "bigint")("ids", "cut.skip", "cut.n").alias("ids_crc32"),
        "doc_tokens",
        (F.floor(F.col("pos") / window) + places.sequences).alias("sequence_id"),
        F.pmod("pos", F.lit(window)).alias("offset"),
    )
    return fixed.unionByName(loose.select(*columns))
