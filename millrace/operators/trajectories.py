"""Agent sessions as training rows. A session's turns form a tree of messages; each leaf becomes one or more token rows.

A session is one agent's work and so a bounded group; sessions are spread over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.tokens import common_prefix

#: What a turn is, beside its session and number.
TURN = "prompt array<struct<role:string,content:string>>, response string, prompt_ids array<int>, output_ids array<int>, logprobs array<double>, finish_reason string, tool_call boolean, ill_formed boolean"
#: Sessions that a task holds as Python objects at a time.
SESSIONS = 256


def drift_kind(held: Column, last_start: Column, prompt_ids: Column, output_ids: Column, threshold: int = 1024) -> Column:
    """How a turn's prompt continues held tokens: clean as an exact extension; realign if it departs within the last
    response and its own output is short; else fork."""
    same = common_prefix(held, prompt_ids)
    near = last_start.isNotNull() & (same >= last_start) & (F.size(output_ids) < threshold)
    return F.when(same == F.size(held), "clean").when(near, "realign").otherwise("fork")


class Row:
    """Tokens of one training row, as they grow turn by turn."""

    def __init__(self) -> None:
        self.ids, self.mask, self.logprobs = [], [], []
        self.last = self.prompt = None

    def takes(self, turn: dict, threshold: int) -> bool:
        """Lays the turn's prompt over what is held, if it continues it; the drifted end of the last response goes."""
        p, n = turn["prompt_ids"], len(self.ids)
        if p[:n] != self.ids:
            if self.last is None or p[: self.last] != self.ids[: self.last] or len(turn["output_ids"]) >= threshold:
                return False
            n = self.last
        self.extend(n, p[n:], 0, None)
        return True

    def extend(self, at: int, ids: list, mask: int, logprobs: list | None) -> None:
        for held, new in ((self.ids, ids), (self.mask, [mask] * len(ids)), (self.logprobs, logprobs or [0.0] * len(ids))):
            held[at:] = new

    def add(self, turn: dict, trained: bool) -> None:
        if self.prompt is None:
            self.prompt = len(turn["prompt_ids"])
        self.last = len(self.ids)
        self.extend(self.last, turn["output_ids"], int(trained), turn["logprobs"] if trained else None)


def session_rows(turns: list[dict], threshold: int = 1024, most: int = 0) -> list[dict]:
    """The rows of one session, turns in order. A response that leaves share is trained by the first one only. Where a
    later prompt rewrites a short response that nothing follows, the rewrite takes its place and it isn't trained."""
    parent, message, turn_of, children = [-1], [None], [None], [[]]

    def grow(above: int, m: tuple, turn: dict | None = None) -> int:
        children[above].append(len(parent))
        parent.append(above), message.append(m), turn_of.append(turn), children.append([])
        return len(parent) - 1

    for turn in turns:
        path, at, k = [(m["role"], m["content"]) for m in turn["prompt"]], 0, 0
        if not path:
            continue
        while k < len(path) and (down := next((c for c in children[at] if message[c] == path[k]), None)) is not None:
            at, k = down, k + 1
        said = [c for c in children[at] if message[c][0] == "assistant"]
        if threshold > 0 and k < len(path) and path[k][0] == "assistant" and len(said) == 1:
            old = turn_of[said[0]]
            if not children[said[0]] and old is not None and len(old["output_ids"]) < threshold:
                at, turn_of[said[0]], message[said[0]], k = said[0], None, path[k], k + 1
        for m in path[k:]:
            at = grow(at, m)
        grow(at, ("assistant", turn["response"]), turn)

    out, trained = [], set()
    stack = [0]
    while stack:
        leaf = stack.pop()
        stack += reversed(children[leaf])
        if children[leaf] or leaf == 0:
            continue
        chain, at = [], leaf
        while at > 0:
            chain.append(at)
            at = parent[at]
        made = [n for n in reversed(chain) if turn_of[n] is not None]
        rows: list[Row] = []
        for n in made:
            if not rows or not rows[-1].takes(turn_of[n], threshold):
                rows.append(Row())
                rows[-1].takes(turn_of[n], threshold)
            rows[-1].add(turn_of[n], n not in trained)
            trained.add(n)
        about = {
            "truncated": bool(made) and turn_of[made[-1]]["finish_reason"] == "length", "use_tool": any(bool(turn_of[n]["tool_call"]) for n in made), "ill_formed": any(bool(turn_of[n]["ill_formed"]) for n in made),
        }
        for r in rows:
            if any(r.mask[r.prompt :]):
                end = most or len(r.ids)
                mask = r.mask[r.prompt : end]
                out.append({"row": len(out), "tokens": r.ids[:end], "response_length": len(mask), "loss_mask": mask, "logprobs": r.logprobs[r.prompt : end], **about})
    return out


def training_rows(turns: DataFrame, session: str, number: str, threshold: int = 1024, most: int = 0) -> DataFrame:
    """`turns` holds `session`, `number` and the columns of TURN. The rows of all sessions; a reward is joined by session
    and belongs to every row in full. Null arrays are empty; a turn without a prompt is left out."""
    whole = turns.groupBy(session).agg(F.collect_list(F.struct(F.col(number).alias("number"), *turn_columns(turns))).alias("turns"))
    return built_rows(whole, session, threshold, most)


def turn_columns(of) -> list[Column]:
    """The columns of TURN, of a DataFrame or of a struct."""
    return [of[n].cast(t).alias(n) for n, t in (c.split(" ", 1) for c in TURN.split(", "))]


def built_rows(sessions: DataFrame, session: str, threshold: int = 1024, most: int = 0) -> DataFrame:
    """The training rows of `sessions`, which hold one row each: `session` and `turns`, an array of structs of `number` and TURN in any order."""
    kind = dict(sessions.dtypes)[session]
    arrays = ("prompt", "prompt_ids", "output_ids", "logprobs")
    columns = ["row", "tokens", "response_length", "loss_mask", "logprobs", "truncated", "use_tool", "ill_formed"]
    out = f"{session} {kind}, row int, tokens array<int>, response_length int, loss_mask array<int>, logprobs array<double>, truncated boolean, use_tool boolean, ill_formed boolean"
    schema = to_arrow_schema(sessions.sparkSession.createDataFrame([], out).schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SESSIONS):
                made: list[dict] = []
                for one in batch.slice(at, SESSIONS).to_pylist():
                    turns = sorted(one["turns"], key=lambda t: (t["number"] is None, t["number"]))
                    for t in turns:
                        for n in arrays:
                            t[n] = t[n] or []
                    made += [{session: one[session]} | r for r in session_rows(turns, threshold, most)]
                if made:
                    yield pa.RecordBatch.from_pylist([{c: r[c] for c in (session, *columns)} for r in made], schema=schema)

    return sessions.select(session, "turns").mapInArrow(build, out)
