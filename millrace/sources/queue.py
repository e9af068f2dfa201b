"""A queue of record files as a data source: batch reading by byte ranges, streaming by commits, writing that counts only when committed.

A queue is a folder of JSONL files and of `_commits`, one small file for each commit, numbered from 1, that names the files which
it added. Files without a commit are never read, so a lost or repeated task leaves nothing behind. One writer at a time commits.

`spark.dataSource.register(RecordQueue)`, then `format("record_queue")` with `path` (a folder with or without commits, or one file).
Reading gives (file, offset, record): the place of a record is the byte at which its line begins, the same however ranges are
cut. Options of reading: `bytes` in a range, `strict` (a line that is no JSON is an error with its number; else it is skipped, as blank lines
are). Of streaming: `reader`, the name under which progress is kept; `commits_per_batch`; and `queue`, `capacity`, `consumer`: while
another queue holds `capacity` or more commits that its consumer hasn't taken, nothing more is read."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.window import Window

BLOCK = 1 << 20


class Folder:
    """The few operations on a folder that a queue needs, in any file system that the path names."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def names(self, below: str = "") -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{below}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File)

    def size(self, name: str) -> int:
        return self.fs.get_file_info(f"{self.root}/{name}").size

    def is_file(self) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(self.root).type == fs.FileType.File

    def load(self, name: str):
        """What the JSON file holds; null without one."""
        try:
            with self.fs.open_input_file(f"{self.root}/{name}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def save(self, name: str, value) -> None:
        """Written beside its place and moved there, so that it is never seen half."""
        self.fs.create_dir(f"{self.root}/{name}".rpartition("/")[0], recursive=True)
        beside = f"{self.root}/{name}.{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(beside) as f:
            f.write(json.dumps(value).encode())
        self.fs.move(beside, f"{self.root}/{name}")

    def commits(self) -> int:
        """The number of the last commit."""
        return max((int(n[:20]) for n in self.names("_commits") if re.fullmatch(r"\d{20}\.json", n)), default=0)

    def files_of(self, commit: int) -> list[str]:
        return self.load(f"_commits/{commit:020d}.json")["files"]

    def add(self, files: list[str], more: dict) -> None:
        self.save(f"_commits/{self.commits() + 1:020d}.json", {"files": files} | more)

    def waiting(self, consumer: str) -> int:
        """Commits that the consumer hasn't taken."""
        return self.commits() - ((self.load(f"_taken/{consumer}.json") or {}).get("commit", 0))


@dataclass
class Range(InputPartition):
    """The lines that begin from byte `start` up to `end`."""

    file: str
    start: int
    end: int


def ranges(folder: Folder, files: list[str], size: int) -> list[Range]:
    return [Range(f, at, min(at + size, total)) for f in files for total in [folder.size(f)] for at in range(0, total, size)]


def lines_from(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end); a line that only ends there belongs to the range before."""
    at, held = max(0, start - 1), b""
    stream.seek(at)
    skip = start > 0  # what begins before the range
    while at < end or held:
        block = stream.read(BLOCK)
        parts = (held + block).split(b"\n")
        held = parts.pop()
        for line in parts:
            if skip:
                skip = False
            elif at < end:
                yield at, line
            else:
                return
            at += len(line) + 1
        if at >= end:
            return
        if not block:
            if held and not skip:
                yield at, held
            return


def line_number(stream, offset: int) -> int:
    """The number of the line that begins at `offset`, from 1."""
    stream.seek(0)
    n, left = 1, offset
    while left > 0:
        block = stream.read(min(BLOCK, left))
        n, left = n + block.count(b"\n"), left - len(block)
    return n


class RangeReader:
    """Reading of ranges, the same for tables and streams."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.bytes = options["path"], int(options.get("bytes", 64 << 20))
        self.strict = str(options.get("strict", "false")).lower() == "true"

    def read(self, partition: Range) -> Iterator[tuple]:
        folder = Folder(self.path)
        where = folder.root if partition.file == "" else f"{folder.root}/{partition.file}"
        with folder.fs.open_input_file(where) as stream:
            for offset, line in lines_from(stream, partition.start, partition.end):
                if not line.strip():
                    continue
                try:
                    text = line.decode()
                    json.loads(text)
                except ValueError:
                    if self.strict:
                        raise ValueError(f"{where}, line {line_number(stream, offset)}: no JSON record") from None
                    continue
                yield partition.file or where.rpartition("/")[2], offset, text


class QueueReader(RangeReader, DataSourceReader):
    def partitions(self) -> list[Range]:
        folder = Folder(self.path)
        if folder.is_file():
            total = folder.fs.get_file_info(folder.root).size
            return [Range("", at, min(at + self.bytes, total)) for at in range(0, total, self.bytes)]
        last = folder.commits()
        files = [f for n in range(1, last + 1) for f in folder.files_of(n)] if last else [n for n in folder.names() if n[0] not in "_."]
        return ranges(folder, files, self.bytes)


class QueueStreamReader(RangeReader, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.reader, self.most = options.get("reader", "default"), int(options.get("commits_per_batch", 1 << 60))
        self.queue, self.capacity, self.consumer = options.get("queue"), int(options.get("capacity", 0)), options.get("consumer", "default")

    def planned(self) -> int:
        """Up to where a batch was ever planned; kept beside the queue, so that a new start never falls behind it."""
        return (Folder(self.path).load(f"_planned/{self.reader}.json") or {}).get("commit", 0)

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        planned = self.planned()
        if self.queue and Folder(self.queue).waiting(self.consumer) >= self.capacity:
            return {"commit": planned}
        return {"commit": max(planned, min(Folder(self.path).commits(), planned + self.most))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        folder = Folder(self.path)
        if end["commit"] > self.planned():
            folder.save(f"_planned/{self.reader}.json", end)
        return ranges(folder, [f for n in range(start["commit"] + 1, end["commit"] + 1) for f in folder.files_of(n)], self.bytes)

    def commit(self, end: dict) -> None:
        Folder(self.path).save(f"_taken/{self.reader}.json", end)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class RecordWriter:
    """Each task writes a file of its own in a folder of this write; a commit moves what the tasks that count have written."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        if overwrite:
            raise ValueError("a queue is only added to")
        self.path, self.job, self.writer = options["path"], uuid.uuid4().hex, options.get("writer", "default")

    def streaming(self) -> RecordWriter:
        """A stream's tasks and its commits are told by its name, since each may have a writer object of its own."""
        self.job = f"stream-{self.writer}"
        return self

    def write(self, iterator: Iterator) -> Written:
        folder, name, rows = Folder(self.path), f"{uuid.uuid4().hex}.jsonl", 0
        folder.fs.create_dir(f"{folder.root}/_open/{self.job}", recursive=True)
        with folder.fs.open_output_stream(f"{folder.root}/_open/{self.job}/{name}") as out:
            for row in iterator:
                fields = row.asDict(recursive=True)
                text = fields["record"] if list(fields) == ["record"] else json.dumps(fields, default=str)
                if text is None or "\n" in text:
                    raise ValueError("a record is one line")
                out.write(text.encode() + b"\n")
                rows += 1
        return Written(name, rows)

    def _commit(self, messages: list[Written | None], more: dict) -> None:
        folder, files = Folder(self.path), []
        for m in messages:
            if m is not None and m.rows:
                files.append(m.file)
                folder.fs.move(f"{folder.root}/_open/{self.job}/{m.file}", f"{folder.root}/{m.file}")
        if files:
            folder.add(files, more)
        self._drop()

    def _drop(self) -> None:
        from pyarrow import fs

        folder = Folder(self.path)
        if folder.fs.get_file_info(f"{folder.root}/_open/{self.job}").type == fs.FileType.Directory:
            folder.fs.delete_dir(f"{folder.root}/_open/{self.job}")


class QueueWriter(RecordWriter, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._commit(messages, {})

    def abort(self, messages: list) -> None:
        self._drop()


class QueueStreamWriter(RecordWriter, DataSourceStreamWriter):
    """A batch that is committed again changes nothing."""

    def commit(self, messages: list, batchId: int) -> None:
        folder, done = Folder(self.path), f"_batches/{self.writer}.json"
        last = folder.load(done)
        if last is not None and last["batch"] >= batchId or self._committed(folder, batchId):
            self._drop()
        else:
            self._commit(messages, {"writer": self.writer, "batch": batchId})
        folder.save(done, {"batch": max(batchId, last["batch"] if last else 0)})

    def _committed(self, folder: Folder, batch: int) -> bool:
        """Whether the last commit is this batch's, of which only the note was lost."""
        n = folder.commits()
        said = folder.load(f"_commits/{n:020d}.json") if n else {}
        return (said.get("writer"), said.get("batch")) == (self.writer, batch)

    def abort(self, messages: list, batchId: int) -> None:
        self._drop()


class RecordQueue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_queue"

    def schema(self) -> str:
        return "file string, offset bigint, record string"

    def reader(self, schema) -> QueueReader:
        return QueueReader(dict(self.options))

    def streamReader(self, schema) -> QueueStreamReader:
        return QueueStreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> QueueWriter:
        return QueueWriter(dict(self.options), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> QueueStreamWriter:
        return QueueStreamWriter(dict(self.options), overwrite).streaming()


def queue_records(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of a queue with `row_pos`, their number from 0 by file and place; counts by file and range say what lies before."""
    spark.dataSource.register(RecordQueue)
    rows = spark.read.format("record_queue").option("path", path).options(**options).load()
    step = 1 << 24
    rows = rows.withColumn("__range", F.floor(F.col("offset") / step))
    counts = rows.groupBy("file", "__range").agg(F.count("*").alias("n"))  # one row for each 16 MB
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy("file", "__range").orderBy("offset")) - 1
    placed = rows.withColumn("__here", here).join(counts.select("file", "__range", before.alias("__before")), ["file", "__range"])
    return placed.select("file", "offset", "record", (F.col("__before") + F.col("__here")).cast("bigint").alias("row_pos"))
