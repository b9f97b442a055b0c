"""MIDI as a data source: ``spark.read.format("midi")``, and a writer that
commits.

Reading gives one row a file: path, length, modified (milliseconds), content,
problem (null for a readable file). Files are listed once on the driver and
dealt to partitions by bytes; filters on path endings and on length are applied
to the listing, so what they exclude is never opened.

Writing takes (name, content): tasks write under a temporary folder of the job,
the commit moves every file to its place, and an aborted job leaves nothing. A
job refuses at commit to replace a file, unless ``overwrite`` is ``true``.

Paths may have any scheme that ``pyarrow.fs`` knows; executors and driver must
reach the same store.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from . import smf

SUFFIXES = (".mid", ".midi")
#: Bytes of files that a partition reads at most, unless one file has more.
PARTITION_BYTES = 32 << 20


@dataclass
class _Files(InputPartition):
    files: tuple[tuple[str, int, int], ...]


@dataclass
class _Written(WriterCommitMessage):
    names: tuple[str, ...]


def problem_of(content: bytes) -> str | None:
    try:
        smf.decode(content)
    except smf.SmfError as e:
        return str(e)
    return None


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it without a slash at its end."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store, at.rstrip("/")


def dealt(files: list[tuple[str, int, int]], most: int) -> list[tuple[tuple[str, int, int], ...]]:
    """Files in the order of their names, cut where a partition would pass ``most`` bytes."""
    parts, held, size = [], [], 0
    for file in sorted(files):
        if held and size + file[1] > most:
            parts.append(tuple(held))
            held, size = [], 0
        held.append(file)
        size += file[1]
    return [*parts, tuple(held)] if held else parts


class MidiReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            simple = (isinstance(f, StringEndsWith) and f.attribute == ("path",)) or (isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("length",))
            if simple:
                self.tests.append(f)
            else:
                yield f

    def _passes(self, path: str, length: int) -> bool:
        def one(f: Filter) -> bool:
            if isinstance(f, StringEndsWith):
                return path.endswith(f.value)
            return {EqualTo: length == f.value, GreaterThan: length > f.value, GreaterThanOrEqual: length >= f.value, LessThan: length < f.value, LessThanOrEqual: length <= f.value}[type(f)]

        return all(map(one, self.tests))

    def partitions(self) -> Sequence[InputPartition]:
        store, root = _store(self.path)
        found = [store.get_file_info(root)] if store.get_file_info(root).type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        files = [(i.path, i.size, int((i.mtime_ns or 0) // 1_000_000)) for i in found if i.type == fs.FileType.File and i.path.lower().endswith(SUFFIXES) and self._passes(i.path, i.size)]
        return [_Files(part) for part in dealt(files, self.most)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path, length, modified in partition.files:
            with store.open_input_stream(path) as stream:
                content = stream.read()
            yield path, length, modified, content, problem_of(content)


class MidiWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        if schema.fieldNames() != ["name", "content"]:
            raise ValueError(f"a MIDI sink takes (name, content), not {schema.fieldNames()}")
        self.path, self.replaces = options["path"], options.get("overwrite", "false").lower() == "true"
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = _store(self.path)
        folder = f"{root}/{self.job}/{uuid.uuid4().hex}"  # a retried task writes to a folder of its own
        store.create_dir(folder)
        names = []
        for row in rows:
            if not row.name or "/" in row.name or row.content is None:
                raise ValueError(f"no file can be written for {row.name!r}")
            with store.open_output_stream(f"{folder}/{row.name}") as out:
                out.write(bytes(row.content))
            names.append(f"{folder}/{row.name}")
        return _Written(tuple(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        moves = [(at, f"{root}/{at.rsplit('/', 1)[1]}") for m in messages if m is not None for at in m.names]
        twice = len(moves) - len({to for _, to in moves})
        there = [] if self.replaces else [i.path for i in store.get_file_info([to for _, to in moves]) if i.type != fs.FileType.NotFound]
        if twice or there:
            self.abort(messages)
            raise FileExistsError(f"{twice} names are repeated" if twice else f"{there[0]} exists")
        for at, to in moves:
            store.move(at, to)
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")


class MidiDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return "path string, length long, modified long, content binary, problem string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MidiReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MidiWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make ``midi`` known to the session, and its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MidiDataSource)
