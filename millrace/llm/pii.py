"""Personal data: fixed rules, and what a character-level bidirectional LSTM with CRF transitions adds to them.

The network is trained in numpy from labelled spans (those of the rules in a bounded sample of documents, and
generated ones in forms that the rules don't know). It reads overlapping windows around every digit and at-sign, of
which each kind has at least one; the spans decoded in the windows of a text are then reconciled over the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
#: The given patterns, the local part of an address apart; possessive where giving back can't help.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LEFT = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = "[0-9@]"
WINDOW, STRIDE = 96, 48
TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind
PAD, VOCABULARY = 130, 131


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, stop, kind) of the rules, leftmost non-overlapping for each kind."""
    out = []
    stop, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > stop and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            stop = m.end()
        at = text.find("@", max(at + 1, stop))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in CARD.finditer(text):
        if 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    for m in PHONE.finditer(text):
        if 10 <= len(DIGIT.findall(m[0])) <= 15:
            out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def characters(text: str) -> np.ndarray:
    """Code points, other than ASCII as one of two classes."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(c < 128, c, np.where(c < 0x2000, 128, 129)).astype(np.int16)


def starts_of(c: np.ndarray) -> np.ndarray:
    """Where the windows start that hold a digit or an at-sign."""
    at = np.flatnonzero(((c >= 48) & (c <= 57)) | (c == 64)) // STRIDE
    if len(c) <= WINDOW and len(at):
        return np.zeros(1, dtype=np.int64)
    k = np.unique(np.concatenate([at, at - 1]))
    return k[k >= 0] * STRIDE if len(k) else k


def cut_windows(c: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The windows of a text at `starts`, padded beyond its end."""
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < len(c), c[np.minimum(at, max(len(c) - 1, 0))], np.int16(PAD)).astype(np.int16) if len(starts) else np.zeros((0, WINDOW), dtype=np.int16)


def windows(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and padded characters of the windows that hold a digit or an at-sign."""
    starts = starts_of(c)
    return starts, cut_windows(c, starts)


def tagged(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(n + WINDOW, dtype=np.int8)
    for start, stop, kind in spans:
        tags[start:stop] = 2 + 2 * kind
        tags[start] = 1 + 2 * kind
    return tags


class Tagger:
    """Embedding and input weights in one table, two LSTM directions, and a linear chain over the tags."""

    def __init__(self, hidden: int = 20, seed: int = 1):
        rng, h = np.random.default_rng(seed), hidden
        draw = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
        self.h = h
        self.p = {"xf": draw(VOCABULARY, 4 * h, by=0.3), "xb": draw(VOCABULARY, 4 * h, by=0.3), "hf": draw(h, 4 * h, by=h**-0.5), "hb": draw(h, 4 * h, by=h**-0.5), "o": draw(2 * h, TAGS, by=0.2), "ob": draw(TAGS, by=0.0), "t": draw(TAGS, TAGS, by=0.1)}
        for x in ("xf", "xb"):
            self.p[x][:, h : 2 * h] += 1.0  # remember at first

    def lstm(self, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool):
        """x: (time, batch). Hidden states, and what going backwards needs."""
        h = self.h
        steps, batch = x.shape
        out, gates, cells = np.zeros((steps, batch, h), np.float32), [], []
        hid = cell = np.zeros((batch, h), np.float32)
        for t in range(steps):
            z = wx[x[t]] + hid @ wh
            g = np.tanh(z * self.half)
            g[:, : 3 * h] = 0.5 * g[:, : 3 * h] + 0.5
            cell = g[:, h : 2 * h] * cell + g[:, :h] * g[:, 3 * h :]
            hid = g[:, 2 * h : 3 * h] * np.tanh(cell)
            out[t] = hid
            if keep:
                gates.append(g)
                cells.append(cell)
        return out, gates, cells

    @property
    def half(self) -> np.ndarray:
        return np.repeat(np.array([0.5, 1.0], np.float32), [3 * self.h, self.h])

    def back(self, x, wx, wh, out, gates, cells, dout):
        h, (steps, batch) = self.h, x.shape
        dwh, all_dz = np.zeros_like(wh), np.zeros((steps, batch, 4 * h), np.float32)
        dh, dc = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
        for t in range(steps - 1, -1, -1):
            g, tc = gates[t], np.tanh(cells[t])
            i, f, o, n = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            before = cells[t - 1] if t else np.zeros_like(dc)
            dz = np.concatenate([dc * n * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - n * n)], axis=1)
            all_dz[t] = dz
            if t:
                dwh += out[t - 1].T @ dz
            dh, dc = dz @ wh.T, dc * f
        which = (np.arange(VOCABULARY)[:, None] == x.ravel()).astype(np.float32)
        return which @ all_dz.reshape(-1, 4 * h), dwh

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x: (batch, time) -> (time, batch, tags)."""
        p, xt = self.p, np.ascontiguousarray(x.T)
        fwd, bwd = self.lstm(xt, p["xf"], p["hf"], keep), self.lstm(xt[::-1], p["xb"], p["hb"], keep)
        both = np.concatenate([fwd[0], bwd[0][::-1]], axis=2)
        return both @ p["o"] + p["ob"], both, fwd, bwd

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag paths, (batch, time)."""
        e = self.emissions(x)[0]
        steps, batch, _ = e.shape
        score, back = e[0], np.zeros((steps, batch, TAGS), np.int8)
        for t in range(1, steps):
            all_ = score[:, :, None] + self.p["t"]
            back[t] = all_.argmax(axis=1)
            score = all_.max(axis=1) + e[t]
        path = np.zeros((batch, steps), np.int8)
        path[:, -1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[t, np.arange(batch), path[:, t]]
        return path

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Of the mean negative log-likelihood of tag paths y."""
        p, yt, (batch, steps) = self.p, y.T.astype(int), x.shape
        e, both, fwd, bwd = self.emissions(x, keep=True)
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + p["t"], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse((beta[t + 1] + e[t + 1])[:, None, :] + p["t"], 2)
        z = lse(alpha[-1], 1)  # log of the sum over all paths
        de = np.exp(alpha + beta - z[None, :, None])
        k = np.arange(batch)
        gold, dt = e[0, k, yt[0]].sum(), np.zeros((TAGS, TAGS))
        de[0, k, yt[0]] -= 1
        for t in range(1, steps):
            de[t, k, yt[t]] -= 1
            pair = np.exp(alpha[t - 1][:, :, None] + p["t"] + (e[t] + beta[t])[:, None, :] - z[:, None, None])
            dt += pair.sum(axis=0)
            np.add.at(dt, (yt[t - 1], yt[t]), -1)
            gold += e[t, k, yt[t]].sum() + p["t"][yt[t - 1], yt[t]].sum()
        de = (de / batch).astype(np.float32)
        dboth = de @ p["o"].T
        xt, h = np.ascontiguousarray(x.T), self.h
        dxf, dhf = self.back(xt, p["xf"], p["hf"], *fwd, dboth[:, :, :h])
        dxb, dhb = self.back(xt[::-1], p["xb"], p["hb"], *bwd, dboth[::-1, :, h:])
        do = both.reshape(-1, 2 * h).T @ de.reshape(-1, TAGS)
        return float((z.sum() - gold) / batch), {"xf": dxf, "xb": dxb, "hf": dhf, "hb": dhb, "o": do, "ob": de.sum(axis=(0, 1)), "t": (dt / batch).astype(np.float32)}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 2) -> float:
        """Adam with a falling rate. Returns the last loss."""
        rng, loss = np.random.default_rng(seed), 0.0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, total = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                loss, grads = self.gradients(x[rows], y[rows])
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (1 - 0.9 * step / total) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return loss


def made_up(rng: np.random.Generator, kind: int) -> str:
    """A value of a kind, often in a form outside the rules."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdehilmnorstu"), rng.integers(3, 9)))
    if kind == 0:
        return f"{word()}{rng.choice(['.', '_', ''])}{word()}{rng.choice([' @ ', '@', '@'])}{word()}.{rng.choice(['com', 'org', 'net', 'info'])}"
    if kind == 1:
        return rng.choice([".", ". ", "[.]"]).join(str(n) for n in rng.integers(0, 256, 4))
    if kind == 2:
        body = digits(15)
        number = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return rng.choice([" ", "-", ".", "/"]).join(number[k : k + 4] for k in range(0, 16, 4))
    area, mid, end = digits(3), digits(3), digits(4)
    return str(rng.choice([f"({area}) {mid}-{end}", f"+1 {area} {mid} {end}", f"{area}-{mid}-{end}", f"00{digits(2)} {area} {mid} {end}"]))


def generated(prose: list[str], count: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows of prose with one made-up value or, as often, something that only looks like one."""
    rng = np.random.default_rng(seed)
    x, y = np.full((count, WINDOW), PAD, np.int16), np.zeros((count, WINDOW), np.int8)
    other = [lambda: str(rng.integers(0, 10**9)), lambda: f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}", lambda: f"{rng.integers(0, 99)}.{rng.integers(0, 99)}", lambda: f"v{rng.integers(0, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}", lambda: bytes(rng.integers(0, 256, 12).tolist()).hex(), lambda: f"{rng.integers(0, 10**6):,}", lambda: "@" + "".join(rng.choice(list("abcdemnorst"), 6))]
    for k in range(count):
        around, kind = prose[rng.integers(len(prose))] if prose else "", int(rng.integers(0, 8))
        value = made_up(rng, kind) if kind < 4 else other[rng.integers(len(other))]()
        at = int(rng.integers(0, max(1, min(len(around), WINDOW - len(value) - 2))))
        c = characters(f"{around[:at]} {value} {around[at:]}"[:WINDOW])
        x[k, : len(c)] = c
        if kind < 4:
            y[k] = tagged(WINDOW, [(at + 1, at + 1 + len(value), kind)])[:WINDOW]
    return x, y


def fit(docs: DataFrame, sample: int = 1000, made: int = 700) -> Tagger:
    """Trains on at most `sample` labelled windows, from about 4000 documents drawn by hash, and `made` generated ones."""
    total = docs.count()
    drawn = docs.select("text").filter(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(1 << 20)) < int(min(1.0, 4000 / max(1, total)) * (1 << 20)))

    def labelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                starts, x = windows(characters(text))
                tags = tagged(len(text), base_spans(text))
                rows += [(w.tobytes(), tags[s : s + WINDOW].tobytes(), text[max(0, s - WINDOW) : s]) for s, w in zip(starts.tolist(), x)]
            yield pd.DataFrame(rows, columns=["x", "y", "prose"])

    schema = "x binary, y binary, prose string"
    got = drawn.filter(F.col("text").rlike(TRIGGER)).mapInPandas(labelled, schema).orderBy(F.xxhash64("x", F.lit(1)), "x", "y", "prose").limit(sample).collect()
    x, y = generated([r["prose"] for r in got if r["prose"] and not re.search(TRIGGER, r["prose"])], made)
    if got:
        x = np.concatenate([x, np.array([np.frombuffer(r["x"], np.int16) for r in got])])
        y = np.concatenate([y, np.array([np.frombuffer(r["y"], np.int8) for r in got])])
    model = Tagger()
    model.fit(x, y)
    return model


def valid(text: str, kind: int) -> bool:
    """Whether what the network found can be of its kind at all."""
    digits = "".join(DIGIT.findall(text))
    if kind == 0:
        return re.fullmatch(r"[\w.%+-]+\s?@\s?[\w-]+(?:\.[\w-]+)+", text) is not None
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[^\W0-9_]", text)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^\W0-9_]", text)
    return 10 <= len(digits) <= 15 and re.fullmatch(r"\+?[(0-9][0-9 ().-]*[ ().-][0-9 ().-]*[0-9]", text) is not None


def reconciled(text: str, base: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of all windows as one set: those of a kind that overlap or meet are one, blanks and stops at their ends
    don't belong to them, and where spans (those of the rules first, then longer ones) overlap, the first stays."""
    joined: list[list[int]] = []
    inside = [(a, min(b, len(text)), k) for a, b, k in found if a < len(text)]  # the padding of a window is no text
    for start, stop, kind in sorted(inside, key=lambda s: (s[2], s[0], s[1])):
        if joined and joined[-1][2] == kind and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], stop)
        else:
            joined.append([start, stop, kind])
    out, taken = list(base), Taken((s, e) for s, e, _ in base)
    for start, stop, kind in sorted(joined, key=lambda s: (s[0] - s[1], s[0])):
        while stop > start and text[stop - 1] in " .,;:!?\n\t":
            stop -= 1
        while stop > start and text[start] in " .,;:!?\n\t":
            start += 1
        if stop > start and not taken.meets(start, stop) and valid(text[start:stop], kind):
            out.append((start, stop, kind))
            taken.add(start, stop)
    return sorted(out, key=lambda s: (s[0], s[2]))


class Taken:
    """Stretches of a text as sorted ones that don't overlap, found by bisection."""

    def __init__(self, spans):
        self.starts, self.stops = [], []
        for start, stop in sorted(spans):
            if self.stops and start < self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], stop)
            else:
                self.starts.append(start)
                self.stops.append(stop)

    def meets(self, start: int, stop: int) -> bool:
        at = bisect_right(self.stops, start)
        return at < len(self.starts) and self.starts[at] < stop

    def add(self, start: int, stop: int) -> None:
        at = bisect_right(self.stops, start)
        self.starts.insert(at, start)
        self.stops.insert(at, stop)


def spans_of(paths: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, stop, kind) in the text from the tag paths of its windows."""
    out = []
    for path, at in zip(paths, starts.tolist(), strict=True):
        k = 0
        hot = np.flatnonzero(path)
        while len(hot) and k <= hot[-1]:
            k = int(hot[np.searchsorted(hot, k)])
            kind, stop = (int(path[k]) - 1) // 2, k + 1
            while stop < len(path) and path[stop] == 2 + 2 * kind:
                stop += 1
            out.append((at + k, at + stop, kind))
            k = stop
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def find(docs: DataFrame, model: Tagger) -> DataFrame:
    """All columns of `docs` with the spans found in each whole text.

    n_email, n_ip, n_card, n_phone and base_sha256 tell of the rules alone; spans lists those and what the network
    adds. A null or empty text has none. Every row gets its result, repeated or not; an empty table gives an empty
    result; columns with these names are replaced. Texts without a digit and an at-sign aren't sent to Python.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in FOUND.split(", ")]

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([row(*answer) for answer in answers(texts, sent.value)], columns=names)

    kept = docs.drop(*names)
    looked = F.when(F.col("text").rlike(TRIGGER), F.col("text"))
    return kept.withColumn("__found", scan(looked)).select(*[f"`{c}`" for c in kept.columns], *[F.col(f"__found.{c}").alias(c) for c in names])


def row(base: list[tuple[int, int, int]], spans: list[tuple[int, int, int]]) -> tuple:
    counts = [sum(k == kind for _, _, k in base) for kind in range(len(KINDS))]
    return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)


def answers(texts, model: Tagger, most: int = 2048) -> Iterator[tuple[list, list]]:
    """Base and all spans of each text. Windows of several texts are decoded at once, those of a long text in slices."""
    held, size = [], 0

    def flush() -> Iterator[tuple[list, list]]:
        x = [w for _, _, _, w in held if len(w)]
        paths = model.decode(np.concatenate(x)) if x else np.zeros((0, WINDOW), np.int8)
        at = 0
        for text, base, starts, w in held:
            found = spans_of(paths[at : at + len(w)], starts)
            at += len(w)
            yield base, reconciled(text, base, found) if found else base

    for text in texts:
        c = characters(text or "")
        starts = starts_of(c)
        if size + len(starts) > most:
            yield from flush()
            held, size = [], 0
        if len(starts) > most:
            base, found = base_spans(text), []
            for at in range(0, len(starts), most):
                part = starts[at : at + most]
                found += spans_of(model.decode(cut_windows(c, part)), part)
            yield base, reconciled(text, base, found)
            continue
        held.append((text or "", base_spans(text) if text else [], starts, cut_windows(c, starts)))
        size += len(starts)
    yield from flush()


def private_documents(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text")
    return find(slim, fit(slim)).drop("text")
