"""Zip archives as a data source split by members, and lines of answers as one that commits."""

from __future__ import annotations

import contextlib
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

#: Bytes of compressed members that a task reads by default.
TASK_BYTES = 64 << 20


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path if re.match("[a-z0-9+.-]+:/", path) else f"file://{path}")


def _files(store: fs.FileSystem, path: str, suffix: str) -> list[str]:
    info = store.get_file_info(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(suffix))


class _Seekable(io.RawIOBase):
    """A file of Arrow's as Python's own, which a place before its begin is an OSError to."""

    def __init__(self, file: object):
        self.file, self.size, self.place = file, file.size(), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        to = offset + (0, self.place, self.size)[whence]
        if to < 0:
            raise OSError("a place before the file")
        self.place = to
        return to

    def tell(self) -> int:
        return self.place

    def readinto(self, buffer: memoryview) -> int:
        data = self.file.read_at(min(len(buffer), max(0, self.size - self.place)), self.place) if self.place < self.size else b""
        buffer[: len(data)] = data
        self.place += len(data)
        return len(data)


@contextlib.contextmanager
def _archive(store: fs.FileSystem, path: str) -> Iterator[zipfile.ZipFile]:
    with store.open_input_file(path) as file, zipfile.ZipFile(io.BufferedReader(_Seekable(file), 1 << 20)) as archive:
        yield archive


@dataclass
class Members(InputPartition):
    """Members of one archive: from which to before which in its directory."""

    path: str
    first: int
    end: int


class ArchiveReader(DataSourceReader):
    """Partitions are ranges of an archive's members, by the directory at its end; a task reads its own members, one at a time."""

    TESTS = {EqualTo: lambda name, v: name == v, In: lambda name, v: name in v, StringContains: lambda name, v: v in name, StringStartsWith: str.startswith, StringEndsWith: str.endswith}

    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", ".zip")
        self.bytes = int(options.get("taskbytes", TASK_BYTES))
        self.filters: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the interface's name
        """Conditions on a member's name are tested before it is read."""
        for f in filters:
            if type(f) in self.TESTS and f.attribute == ("entry",):
                self.filters.append((type(f), f.value))
            else:
                yield f

    def _wanted(self, info: zipfile.ZipInfo) -> bool:
        return not info.is_dir() and all(self.TESTS[kind](info.filename, value) for kind, value in self.filters)

    def partitions(self) -> list[Members]:
        store, root = _at(self.path)
        out = []
        for path in _files(store, root, self.suffix):
            with _archive(store, path) as archive:
                first = size = 0
                infos = archive.infolist()
                for i, info in enumerate(infos):
                    size += info.compress_size if self._wanted(info) else 0
                    if size >= self.bytes or i == len(infos) - 1:
                        if size:
                            out.append(Members(path, first, i + 1))
                        first, size = i + 1, 0
        return out

    def read(self, partition: Members | None) -> Iterator[tuple[str, str, str]]:
        if partition is None:  # there are none
            return
        store, _ = _at(self.path)
        with _archive(store, partition.path) as archive:
            for info in archive.infolist()[partition.first : partition.end]:
                if self._wanted(info):
                    yield partition.path, info.filename, archive.read(info).decode("utf-8", errors="replace")


class ArchiveSource(DataSource):
    """Format `archive_members`: (archive, entry, text) of zip files under a path. Options: suffix, taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, entry string, text string"

    def reader(self, schema: object) -> ArchiveReader:  # noqa: ARG002
        return ArchiveReader(dict(self.options))


def read_members(spark: SparkSession, path: str, name_has: str = "_10-K_", suffix: str = ".zip", task_bytes: int = TASK_BYTES) -> DataFrame:
    """(archive, entry, text): a row for each member of the zip files whose name has the keyword, decoded as UTF-8.

    An archive of any size is read by as many tasks as it has task_bytes of such members; only the members are in memory, each in turn, and others are
    never unpacked. Folders and archives without such members have no rows. The path is one that Arrow's file systems open.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    rows = spark.read.format("archive_members").option("suffix", suffix).option("taskBytes", str(task_bytes)).load(path)
    return rows.where(F.col("entry").contains(name_has)) if name_has else rows


@dataclass
class Part(WriterCommitMessage):
    """A task's file, not yet part of the table."""

    path: str
    number: int


class AnswerWriter(DataSourceWriter):
    """Each attempt of a task writes a file of its own aside; the files of those that count are moved in once all are there.

    A batch's files have its name, so that a batch that is written again takes the place of what it wrote before.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.batch = options["path"], options["batch"]
        if not re.fullmatch(r"[A-Za-z0-9-]+", self.batch):
            raise ValueError("a batch is named by letters, digits and -")
        self.aside = f"_aside-{self.batch}-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        store, root = _at(self.path)
        store.create_dir(f"{root}/{self.aside}")
        context = TaskContext.get()
        number = context.partitionId() if context else 0
        path = f"{root}/{self.aside}/{number}-{uuid.uuid4().hex}.json"
        with store.open_output_stream(path) as out:
            for row in rows:
                out.write((json.dumps({k: v for k, v in row.asDict(recursive=True).items() if v is not None}, ensure_ascii=False, default=str) + "\n").encode())
        return Part(path, number)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = _at(self.path)
        before = {f.path for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.startswith(f"{self.batch}.part-")}
        now = set()
        for m in messages:
            if m is not None:
                to = f"{root}/{self.batch}.part-{m.number:05}.json"
                store.move(m.path, to)
                now.add(to)
        for path in before - now:
            store.delete_file(path)
        self._clear(store, root)

    def abort(self, messages: list[Part | None]) -> None:  # noqa: ARG002
        self._clear(*_at(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        """Remove what attempts of this batch have left aside, those of runs before too."""
        for f in store.get_file_info(fs.FileSelector(root)):
            if not f.is_file and re.fullmatch(rf"_aside-{self.batch}-[0-9a-f]{{32}}", f.base_name):
                store.delete_dir(f.path)


class AnswerSink(DataSource):
    """Format `answer_lines`, to be written in mode append. Options: path, batch."""

    @classmethod
    def name(cls) -> str:
        return "answer_lines"

    def writer(self, schema: object, overwrite: bool) -> AnswerWriter:  # noqa: ARG002
        return AnswerWriter(dict(self.options))


def append_batch(answers: DataFrame, path: str, batch: str) -> None:
    """Add a batch of answers to the JSON lines under the path, each row once.

    A task that runs again, or twice at once, leaves one file; a batch that fails leaves none; a batch of the same name replaces the one before. Files that start
    with _ don't belong to the table, as Spark's readers have it.
    """
    spark = answers.sparkSession
    spark.dataSource.register(AnswerSink)
    store, root = _at(path)
    store.create_dir(root)
    answers.write.format("answer_lines").mode("append").option("batch", batch).save(path)
