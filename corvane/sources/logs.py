"""Exported commit logs as a data source: partitions of a file, filters read with it, and offsets for a stream."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

#: A record begins with the first mark, its fields are parted by the second: fixed values.
RECORD, FIELD = b"\x1e", b"\x1f"
SCHEMA = "repo string, sha string, short string, data string, author string, parents array<string>, subject string, body string, files array<string>, cards array<int>"
#: Bytes of a file that one task reads, and that it reads at once.
SPLIT, BLOCK = 64 << 20, 1 << 20
#: Tasks beyond which one reads several splits, up to ``SPLIT`` bytes; records that it gives to Spark at once.
TASKS, GIVEN = 256, 1024
_TEXTS = pa.list_(pa.string())
_ROWS = pa.schema([(c, pa.string()) for c in ("repo", "sha", "short", "data", "author")] + [("parents", _TEXTS), ("subject", pa.string()), ("body", pa.string()), ("files", _TEXTS), ("cards", pa.list_(pa.int32()))])


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pyarrow.fs.LocalFileSystem(), path)


def _sizes(path: str) -> dict[str, int]:
    """The log files of a folder, or one file, and their sizes."""
    system, at = _opened(path)
    info = system.get_file_info(at)
    found = [info] if info.is_file else system.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
    return {f.path: f.size for f in found if f.is_file and not re.search(r"(^|/)[._]", f.path[len(at) :])}


def repo_of(path: str) -> str:
    """The repository that a file is a log of: its name without an ending."""
    return path.rsplit("/", 1)[-1].split(".", 1)[0]


def ranges(sizes: dict[str, int], split: int, begins: dict[str, int] | None = None) -> list[Range]:
    """The ranges of files that tasks read: ``split`` bytes, or more of them where these make more than ``TASKS``."""
    begins = begins or {}
    whole = sum(max(size - begins.get(path, 0), 0) for path, size in sizes.items())
    step = split * max(1, min(-(-whole // (split * TASKS)), SPLIT // split))
    return [Range(path, at, min(at + step, size)) for path, size in sorted(sizes.items()) for at in range(begins.get(path, 0), size, step)]


@dataclass
class Range(InputPartition):
    """The records that begin in a range of bytes of a file."""

    path: str
    begin: int
    end: int


def records(root: str, part: Range) -> Iterator[bytes]:
    """The records that begin in ``part``, whole, whatever they are cut by; at most a block and a record are in memory."""
    system, _ = _opened(root)
    with system.open_input_file(part.path) as file:
        file.seek(part.begin)
        at, held, inside = part.begin, b"", False
        while block := file.read(BLOCK):
            pieces = (held + block).split(RECORD)
            start = at - len(held)
            for i, piece in enumerate(pieces[:-1]):
                # a piece after a mark is a record; the one before the first mark began in the range before
                if inside or i:
                    yield piece
                start += len(piece) + 1
                if start - 1 >= part.end:
                    return
                inside = True
            held, at = pieces[-1], at + len(block)
        if inside:
            yield held


def parsed(repo: str, raw: bytes) -> tuple | None:
    """A record as a row: sha, short, date, author, parents, subject, body, files. One with fewer fields is none."""
    fields = raw.decode(errors="replace").split(FIELD.decode())
    if len(fields) < 8:
        return None
    sha, short, date, author, parents, subject, body, files = fields[:8]
    cards = dict.fromkeys(int(n) for n in re.findall(r"#([0-9]{3,5})\b", f"{subject}\n{body}"))
    return repo, sha.strip(), short, date, author, parents.split(), subject, body.strip(), [f.strip() for f in files.split("\n") if f.strip()], list(cards)


class _Choice:
    """What of a log is read: options, and filters that Spark hands over."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.since = options.get("since")
        self.most = int(options["maxcount"]) if "maxcount" in options else None
        self.merges = options.get("merges", "false").lower() == "true"
        self.split = int(options.get("split", SPLIT))
        self.repos: set[str] | None = None
        self.after: str | None = None

    def batches(self, parts: Iterator[Range]) -> Iterator[pa.RecordBatch]:
        rows = self.rows(parts)
        while some := list(islice(rows, GIVEN)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _ROWS, strict=True)], schema=_ROWS)

    def rows(self, parts: Iterator[Range]) -> Iterator[tuple]:
        for part in parts:
            given = 0
            for raw in records(self.path, part):
                row = parsed(repo_of(part.path), raw)
                if row is None or (not self.merges and len(row[5]) > 1) or (self.since and row[3] < self.since) or (self.after and row[3] < self.after):
                    continue
                yield row
                given += 1
                if given == self.most:
                    break


class _Reader(_Choice, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A lower bound of the date skips records where they are read, a repository skips files; Spark looks at all others."""
        for f in filters:
            if self.most is None and isinstance(f, GreaterThanOrEqual) and f.attribute == ("data",):
                self.after = max(self.after or "", f.value)
            elif isinstance(f, EqualTo | In) and f.attribute == ("repo",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.repos = values if self.repos is None else self.repos & values
            elif not isinstance(f, IsNotNull):  # no column has nulls
                if self.most is None and isinstance(f, GreaterThan) and f.attribute == ("data",):
                    self.after = max(self.after or "", f.value)
                yield f

    def partitions(self) -> list[Range]:
        sizes = {path: size for path, size in _sizes(self.path).items() if self.repos is None or repo_of(path) in self.repos}
        # with a largest count a log is read from its beginning and no further than that
        out = ranges(sizes, self.split) if self.most is None else [Range(path, 0, size) for path, size in sorted(sizes.items()) if size]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.batches([partition]) if partition.path else iter(())


class _StreamReader(_Choice, DataSourceStreamReader):
    """An offset is how many bytes of each file have been read; a log grows by whole records at its end."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return _sizes(self.path)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(end, self.split, start)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.batches([partition])


class CommitLog(DataSource):
    """``spark.read.format("commitlog").load(path)``: commits (``SCHEMA``) of the logs in a folder, one file a repository.

    Options: ``since`` leaves out earlier dates, ``maxcount`` reads that many commits of each log from its beginning, after
    the other options, ``merges`` keeps commits of several parents, ``split`` is how many bytes a task reads, or more where
    that makes more than ``TASKS``. Broken records
    are passed over. With ``maxcount`` no date is pushed, as it is counted before any filter. Files are opened by every task, so a folder that driver and executors share, or a store that
    Arrow opens by its address, has to hold them.
    """

    @classmethod
    def name(cls) -> str:
        return "commitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand its filters over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CommitLog)
