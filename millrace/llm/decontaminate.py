"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping segments, so a copied passage holds a whole segment even when the item
isn't copied whole. A segment of m characters that occurs with at most k edits shares at least
m - q + 1 - k * q of its q-grams with the document, on diagonals that differ by k at most. Shared q-grams are counted
in overlapping bands of diagonals; only bands that reach this bound are aligned, and the aligned distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, numbered, written

Q = 10
#: Hash of a q-gram: powers 1, 2 and 4 of an odd multiplier, modulo 2^64.
BASES = [np.uint64(pow(0x9E3779B97F4A7C15, e, 1 << 64)) for e in (1, 2, 4)]
HIT = "array<struct<item_id:bigint,start:bigint,stop:bigint,edits:int>>"


class Letters:
    """Lower case; every run of other characters than letters and digits is one space."""

    def __init__(self):
        self.alnum = np.zeros(0x110000, dtype=bool)
        self.known = np.zeros(0x110000 >> 8, dtype=bool)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points, and where each stands in `text`."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for page in np.flatnonzero(np.bincount(c >> 8, minlength=len(self.known)).astype(bool) & ~self.known):
            for x in range(page << 8, (page + 1) << 8):
                self.alnum[x] = chr(x).isalnum()
            self.known[page] = True
        word = self.alnum[c]
        keep = word.copy()
        keep[1:] |= word[:-1]
        at = np.flatnonzero(keep)
        return np.where(word[at], c[at], np.uint32(32)), at


def grams(c: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams (q = 10: of 8 and 2)."""
    if len(c) < Q:
        return np.zeros(0, dtype=np.uint64)
    one = c.astype(np.uint64) + np.uint64(1)
    b1, b2, b4 = BASES
    two = one[:-1] * b1 + one[1:]
    four = two[:-2] * b2 + two[2:]
    eight = four[:-4] * b4 + four[4:]
    ten = eight[:-2] * b2 + two[8:]
    return (ten ^ (ten >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """Segments of the items of one block, and where each q-gram occurs in them."""

    def __init__(self, items: list[tuple[int, str]], segment: int, rate: float):
        letters, self.chars, self.item, self.edits, self.need = Letters(), [], [], [], []
        codes, owner, offset = [], [], []
        for item, text in items:
            c, _ = letters(text or "")
            if len(c) and c[-1] == 32:
                c = c[:-1]
            starts = [0] if len(c) <= segment else [*range(0, len(c) - segment, segment // 2), len(c) - segment]
            for s in starts:
                part = c[s : s + segment]
                if len(part) < 2 * Q:  # too short to tell a copy from chance
                    continue
                k = min(int(rate * len(part)), 2 * (len(part) - Q + 1) // (3 * Q))  # a third of the q-grams must be left
                g = grams(part)
                codes.append(g)
                owner.append(np.full(len(g), len(self.chars)))
                offset.append(np.arange(len(g)))
                self.chars.append(part)
                self.item.append(item)
                self.edits.append(k)
                self.need.append(len(part) - Q + 1 - k * Q)
        if not codes:
            return
        codes, owner, offset = np.concatenate(codes), np.concatenate(owner), np.concatenate(offset)
        order = np.argsort(codes, kind="stable")
        self.codes, self.owner, self.offset = codes[order], owner[order], offset[order]
        self.bits = max(16, int(len(codes) * 16).bit_length())
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[codes >> np.uint64(64 - self.bits)] = True
        self.edits, self.need, self.length = np.array(self.edits), np.array(self.need), np.array([len(c) for c in self.chars])
        self.least, self.span = int(self.need.min()), int(segment + self.edits.max() + 1)

    def find(self, c: np.ndarray, block: int = 1 << 19) -> dict[int, tuple[int, int, int]]:
        """For each item found: start, stop and edits of the best region, earliest first."""
        best: dict[int, tuple[int, int, int]] = {}
        if not self.chars:
            return best
        for at in range(0, max(1, len(c)), block):  # blocks overlap by more than a region
            part = c[at : at + block + 2 * self.span]
            for item, start, stop, edits in self.regions(part):
                if item not in best or (edits, start + at) < (best[item][2], best[item][0]):
                    best[item] = start + at, stop + at, edits
        return best

    def regions(self, c: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        g = grams(c)
        i = np.flatnonzero(self.seen[g >> np.uint64(64 - self.bits)])
        if len(i) < self.least:
            return
        upto = np.searchsorted(i, i + self.span)
        dense = np.flatnonzero(upto - np.arange(len(i)) >= self.least)  # where so many q-grams lie close enough
        if not len(dense):
            return
        cover = np.bincount(dense, minlength=len(i) + 1) - np.bincount(upto[dense], minlength=len(i) + 1)
        i = i[np.cumsum(cover)[:-1] > 0]
        lo, hi = np.searchsorted(self.codes, g[i], side="left"), np.searchsorted(self.codes, g[i], side="right")
        width = 2 * int(self.edits.max()) + 2
        key, count = self.counted(i, lo, hi - lo, width)
        seg, band = key >> 32, (key & 0xFFFFFFFF) - (1 << 30)
        ok = count >= self.need[seg]
        seg, band = seg[ok], band[ok]
        first = band // 2 * width + (band % 2) * (width // 2)  # smallest diagonal of the band
        if not len(seg):
            return
        exact, slack = set(), int(self.edits.max())
        early = np.argsort(first, kind="stable")
        seg, first = seg[early], first[early]
        for x, f in zip(seg.tolist(), first.tolist(), strict=True):  # whole segments without an edit need no alignment
            if self.item[x] in exact:  # the earliest is known
                continue
            lo = max(0, f - slack)
            at = c[lo : f + width + slack + len(self.chars[x])].tobytes().find(self.chars[x].tobytes())
            if at >= 0 and at % 4 == 0:
                exact.add(self.item[x])
                yield self.item[x], lo + at // 4, lo + at // 4 + len(self.chars[x]), 0
        rest = np.array([self.item[x] not in exact for x in seg], dtype=bool)
        yield from self.aligned(c, seg[rest], first[rest], width)

    def counted(self, i: np.ndarray, lo: np.ndarray, n: np.ndarray, width: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(key, count): how many q-grams a segment shares with the text in each band of diagonals; `i` are places of the text whose q-grams
        stand `n` times in the index, from `lo` on.

        About `most` hits are laid out at a time and added up by segment and band, so q-grams that very many items share take time
        but no memory."""
        upto, keys, counts, held = np.cumsum(n), [], [], 0
        cuts = np.unique(np.searchsorted(upto, np.arange(most, int(upto[-1]) + most, most))) + 1 if len(n) else []
        start = 0
        for stop in [*cuts, len(n)]:
            some = slice(start, stop)
            start = stop
            m = n[some]
            if not m.sum():
                continue
            at = np.repeat(lo[some], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            seg, diagonal = self.owner[at], np.repeat(i[some], m) - self.offset[at]
            band = np.concatenate([diagonal // width * 2, (diagonal - width // 2) // width * 2 + 1])  # each diagonal is in two bands
            key, count = np.unique(np.concatenate([seg, seg]) * (1 << 32) + (band + (1 << 30)), return_counts=True)
            keys, counts, held = [*keys, key], [*counts, count], held + len(key)
            if len(keys) > 1 and held > most:
                keys, counts = ([x] for x in _added(keys, counts))
                held = len(keys[0])
        return _added(keys, counts) if keys else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def aligned(self, c: np.ndarray, seg: np.ndarray, first: np.ndarray, width: int, most: int = 512) -> Iterator[tuple[int, int, int, int]]:
        """Banded alignments of segments `seg` whose diagonals start in [first, first + width), all at once."""
        for at in range(0, len(seg), most):
            s, f = seg[at : at + most], first[at : at + most]
            dist, start, stop = banded(c, [self.chars[x] for x in s], f - self.edits[s], width + 2 * int(self.edits.max()))
            for x, d, a, b in zip(s, dist, start, stop, strict=True):
                if d <= self.edits[x]:
                    yield self.item[x], int(a), int(b), int(d)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its counts."""
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


def banded(c: np.ndarray, parts: list[np.ndarray], first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits that turn each part into a stretch of `c` along diagonals first to first + width: the
    distance, and the stretch. Column w of row j stands for the prefix of c that ends at first + w + j."""
    n, longest = len(parts), max(map(len, parts))
    far = np.int64(1 << 20)
    lengths = np.array([len(p) for p in parts])
    p = np.zeros((n, longest), dtype=np.uint32)
    for k, x in enumerate(parts):
        p[k, : len(x)] = x
    w = np.arange(width + 1)
    end = first[:, None] + w
    cost = np.where((end >= 0) & (end <= len(c)), 0, far)
    begin = end.copy()
    rows = np.arange(n)[:, None]
    for j in range(1, longest + 1):
        end = end + 1
        letter = np.where((end >= 1) & (end <= len(c)), c[np.clip(end - 1, 0, len(c) - 1)], 0)
        same = cost + (letter != p[:, j - 1 : j])
        skip = np.concatenate([cost[:, 1:], np.full((n, 1), far)], axis=1) + 1  # a letter of the part is missing
        new = np.minimum(same, skip)
        new = np.where((end >= 0) & (end <= len(c)), new, far)
        from_ = np.where(same <= skip, begin, np.concatenate([begin[:, 1:], begin[:, -1:]], axis=1))
        best = np.minimum.accumulate(new - w, axis=1)  # letters of c that the part lacks
        source = np.maximum.accumulate(np.where(new - w == best, w, -1), axis=1)
        new, from_ = best + w, from_[rows, source]
        live = (j <= lengths)[:, None]
        cost, begin, end = np.where(live, new, cost), np.where(live, from_, begin), np.where(live, end, end - 1)
    pick = cost.argmin(axis=1)
    k = np.arange(n)
    return cost[k, pick], begin[k, pick], end[k, pick]


def blocks_of(items: DataFrame, block_chars: int) -> list[DataFrame]:
    """`items` in parts of about `block_chars` characters, so that what one broadcast holds is bounded. Repeated items count once."""
    items = items.select("item_id", "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def indexed(block: DataFrame, segment: int, rate: float):
    """The broadcast index of one block; a few times its characters."""
    rows = [(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").toLocalIterator()]
    return block.sparkSession.sparkContext.broadcast(Index(rows, segment, rate))


def finder(sent):
    @F.pandas_udf(HIT)
    def find(texts: pd.Series) -> pd.Series:
        letters, index, out = Letters(), sent.value, []
        for text in texts:
            hits = []
            if text:
                c, at = letters(text)
                for item, (start, stop, edits) in sorted(index.find(c).items(), key=lambda x: (x[0] is None, x)):
                    if stop > start:
                        hits.append({"item_id": item, "start": int(at[start]), "stop": int(at[stop - 1]) + 1, "edits": edits})
            out.append(hits)
        return pd.Series(out)

    return find


def contaminated(docs: DataFrame, items: DataFrame, segment: int = 100, rate: float = 0.06, block_chars: int = 8_000_000) -> DataFrame:
    """All columns of `docs` and `leaks`, an array of (item_id, start, stop, edits): the best region of each item, start
    and stop in code points.

    A null or empty text has no leaks, nor has any text when `items` is empty. Items of fewer than 20
    letters, digits and single spaces can't be told from chance and match nothing; null item texts neither. An item with
    a null id is reported with it. Repeated items report as one id. Rows of `docs` are kept whatever repeats in them;
    a column named leaks is replaced. Items that fit in one block of `block_chars` characters are broadcast and no row is
    shuffled; more are searched block by block: the hits of one are written before the next is built, so one index lives at
    a time, and the hits meet their rows in the end (a column named __row is then left out).
    """
    blocks = blocks_of(items, block_chars)
    if len(blocks) == 1:
        return docs.drop("leaks").withColumn("leaks", finder(indexed(blocks[0], segment, rate))("text"))
    rows, found = numbered(docs).drop("leaks"), []
    for block in blocks:
        sent = indexed(block, segment, rate)
        hits = rows.select(ROW, finder(sent)("text").alias("leaks")).filter(F.size("leaks") > 0)
        found.append(written(hits, "leaks"))
        sent.destroy()
    leaks = reduce(DataFrame.unionAll, found).groupBy(ROW).agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    return rows.join(leaks, ROW, "left").withColumn("leaks", F.coalesce("leaks", F.array().cast(HIT))).drop(ROW)


def leaked_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contaminated(docs, items).select("doc_id", "leaks")
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
