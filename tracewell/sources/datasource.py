"""Transcripts as a Spark data source: ``spark.read.format("transcripts")``.

Files are listed once, and only those that pass the pushed filters make input partitions: on
``path``, ``session`` (a file's name without its ending), ``project`` (its folder's name),
``modified`` and ``size``. Small files share a partition of about ``split`` bytes; line files
beyond that are cut into ranges of bytes, each of which yields the lines that begin in it, so a
long transcript is read by several tasks. Whole-file formats are read in one piece up to ``cap``
bytes; a larger file gives an error row and isn't opened.

Rows are raw (one a line, or one a file); ``events`` normalises them with the column expressions of
``transcripts``, in the JVM. Any file system that Arrow knows can be read: local, hdfs, s3, gs.

Edge cases: an empty folder gives no rows; blank lines are left out; bytes that are no UTF-8 become
replacement signs; hidden files and folders (``.`` or ``_`` first) are passed over, as by Spark's
own readers; a file that goes between listing and reading is an error.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from ..functions.constants import FILE_CAP
from . import transcripts as tr

NAME = "transcripts"
SCHEMA = "path string, session string, project string, modified timestamp, size bigint, offset bigint, value string, err string"
FILE_COLUMNS = ("path", "session", "project", "modified", "size")
SPLIT = 64 << 20
#: Bytes that are read at a time, and about as many of text in a batch.
CHUNK = 1 << 20
#: Of each format: its files' names, and whether a file is one value.
KINDS = {"claude": ("*.jsonl", False), "codex": ("*.jsonl", False), "cline": ("api_conversation_history.json", True), "gemini": ("*.json*", True)}


@dataclass(frozen=True)
class File:
    path: str  # as Spark writes it
    inner: str  # as the file system knows it
    session: str
    project: str
    modified: datetime
    size: int


@dataclass
class Piece(InputPartition):
    """Ranges of bytes of files: (file, first, end)."""

    ranges: list[tuple[File, int, int]]


def _system(path: str):
    from pyarrow import fs

    scheme = urlsplit(path).scheme
    if len(scheme) > 1 and scheme != "file":
        system, inner = fs.FileSystem.from_uri(path)
        head = path[: len(path) - len(inner.rstrip("/"))] if path.rstrip("/").endswith(inner.rstrip("/")) else f"{scheme}://"
        return system, inner, head
    return fs.LocalFileSystem(), unquote(urlsplit(path).path) if scheme == "file" else os.path.abspath(path), "file:"


def listed(path: str, glob: str) -> Iterator[File]:
    """Files below a path whose names fit, in order of their paths."""
    from pyarrow import fs

    system, inner, head = _system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    for f in sorted(found, key=lambda f: f.path):
        below = f.path[len(inner) :].split("/") if f is not info else []
        if f.type != fs.FileType.File or any(part[:1] in "._" for part in below if part) or not fnmatch.fnmatchcase(f.base_name, glob):
            continue
        folder = f.path.rsplit("/", 2)
        when = (f.mtime or datetime.fromtimestamp(0, timezone.utc)).astimezone(timezone.utc)
        yield File(head + quote(f.path, safe="/:@!$&'()*+,;=~-._"), f.path, f.base_name.rsplit(".", 1)[0], folder[-2] if len(folder) > 1 else "", when, f.size)


def opened(path: str, inner: str):
    """Where every file is opened."""
    return _system(path)[0].open_input_file(inner)


def _when(value) -> datetime:
    return value.astimezone(timezone.utc) if value.tzinfo else value.replace(tzinfo=timezone.utc)


TESTS = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


def passes(file: File, test: Filter) -> bool:
    if isinstance(test, Not):
        return not passes(file, test.child)
    value = test.value
    if test.attribute == ("modified",):
        value = tuple(map(_when, value)) if isinstance(test, In) else _when(value)
    return TESTS[type(test)](getattr(file, test.attribute[0]), value)


def known(test: Filter) -> bool:
    if isinstance(test, Not):
        return known(test.child)
    values = test.value if isinstance(test, In) else (getattr(test, "value", None),)
    return type(test) in TESTS and len(test.attribute) == 1 and test.attribute[0] in FILE_COLUMNS and all(v is not None for v in values)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        kind = options.get("kind", "claude")
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; known: {', '.join(sorted(KINDS))}")
        glob, whole = KINDS[kind]
        self.glob, self.whole = options.get("glob", glob), options.get("whole", str(whole)).lower() == "true"
        self.split, self.cap = int(options.get("split", SPLIT)), int(options.get("cap", FILE_CAP))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for test in filters:
            if known(test):
                self.filters.append(test)
            else:
                yield test

    def partitions(self) -> list[Piece]:
        """Files that pass the filters, in pieces of about ``split`` bytes."""
        pieces, now, size = [], [], 0
        for file in listed(self.path, self.glob):
            if not all(passes(file, test) for test in self.filters):
                continue
            cuts = [0, file.size] if self.whole or file.size <= self.split else [*range(0, file.size, self.split), file.size]
            for first, end in zip(cuts, cuts[1:]):
                weight = 0 if self.whole and file.size > self.cap else end - first
                if now and size + weight > self.split:
                    pieces.append(Piece(now))
                    now, size = [], 0
                now.append((file, first, end))
                size += weight
        return [*pieces, Piece(now)] if now else pieces or [Piece([])]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        for file, first, end in piece.ranges:
            if not self.whole:
                for offsets, values in lines_of(file.path, file.inner, first, end):
                    yield batch_of(file, offsets, values, [None] * len(values))
            elif file.size > self.cap:
                yield batch_of(file, [0], [None], ["too_large"])
            else:
                with opened(file.path, file.inner) as f:
                    yield batch_of(file, [0], [bytes(f.read()).decode("utf-8", "replace")], [None])


def lines_of(path: str, inner: str, first: int, end: int) -> Iterator[tuple[list[int], list[str]]]:
    """Lines, and where each begins, of those that begin from first up to end."""
    with opened(path, inner) as f:
        at, rest = first, b""
        if first:
            f.seek(first - 1)  # a line that begins before belongs to the range before
            at = first - 1
            while True:
                chunk = f.read(CHUNK)
                if not chunk:
                    return
                cut = chunk.find(b"\n")
                if cut >= 0:
                    at, rest = at + cut + 1, chunk[cut + 1 :]
                    break
                at += len(chunk)
        done = False
        while not done and at < end:
            chunk = f.read(CHUNK)
            done = not chunk
            parts = (rest + chunk).split(b"\n")
            rest = b"" if done else parts.pop()
            offsets, values = [], []
            for part in parts:
                if at >= end:
                    break
                if part.strip():
                    offsets.append(at)
                    values.append(part.decode("utf-8", "replace").removesuffix("\r"))
                at += len(part) + 1
            if values:
                yield offsets, values


_ARROW = pa.schema([("path", pa.string()), ("session", pa.string()), ("project", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("size", pa.int64()), ("offset", pa.int64()), ("value", pa.string()), ("err", pa.string())])


def batch_of(file: File, offsets: list[int], values: list, errs: list) -> pa.RecordBatch:
    n = len(offsets)
    same = [[x] * n for x in (file.path, file.session, file.project, file.modified, file.size)]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip([*same, offsets, values, errs], _ARROW, strict=True)], schema=_ARROW)


class Transcripts(DataSource):
    """Options: ``path`` (of ``load``), ``kind`` (of ``KINDS``), ``glob``, ``whole``, ``split``, ``cap``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session, with filters pushed to it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:  # workers on this machine find the package where the driver does
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, *paths) if x)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Transcripts)
    return spark


def events(spark: SparkSession, path: str, fmt: str = "claude", only: Column | None = None, **options) -> DataFrame:
    """The events of ``transcripts.read_events``, of files for which ``only`` holds: a condition on path, session, project, modified and size."""
    reader = register(spark).read.format(NAME).option("kind", fmt)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    rows = reader.load(path)
    rows = rows if only is None else rows.where(only)
    if KINDS[fmt][1]:
        files = rows.select("path", "value", "err")
        return tr.cline(tr.cline_rows(files)) if fmt == "cline" else tr.gemini(tr.gemini_rows(files))
    numbered = rows.select("path", "value", F.row_number().over(Window.partitionBy("path").orderBy("offset")).alias("seq"))
    return (tr.claude if fmt == "claude" else tr.codex)(tr.decoded(numbered))
