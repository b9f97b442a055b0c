"""What the corpus operators share: lineage cuts, word rules, Arrow plumbing."""

from __future__ import annotations

import math
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: The white space that separates words (ASCII only), as a character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir``
    names it. Where a local session has none, a temporary folder is set; a
    cluster without one is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; what follows survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """As :func:`checkpointed`, but as a Parquet table, for what is read in part."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """The tables that :func:`staged` writes inside go at the end; for callers
    who write their result inside. Tables of other calls stay. Checkpoints go
    with their DataFrames where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            delete(spark, path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Fewer rows a batch for what runs inside: long texts make large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shipped(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast of ``value`` for tasks to call; its class travels with it."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Longer words, in bytes, are not remembered, so that what tasks remember of
#: words is bounded in bytes too.
LONGEST = 64


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered for the frequent words of a task.

    The memory is emptied when it holds ``most`` words, so it stays bounded
    whatever the vocabulary.
    """

    def __init__(self, most: int = 200_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class WordTable(dict):
    """bytes -> row of per-word facts, computed once per frequent word of a task.

    ``fact`` gives the integers of a word, one per column. The table is emptied
    when it holds ``most`` words, so it stays bounded whatever the vocabulary.
    """

    def __init__(self, fact: Callable[[bytes], tuple[int, ...]], columns: int, most: int = 150_000) -> None:
        super().__init__()
        self.fact, self.columns, self.most = fact, columns, most
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.new: list[tuple[int, ...]] = []
        self.table = np.zeros((1024, self.columns), np.uint64)
        self.filled = 0

    def __missing__(self, word: bytes) -> int:
        found = self.filled + len(self.new)
        if len(word) <= LONGEST:
            self[word] = found
        self.new.append(self.fact(word))
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        """One row of facts per word."""
        if self.filled > self.most:
            self._reset()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            n = self.filled + len(self.new)
            while n > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.filled : n] = np.array(self.new, np.uint64)
            self.filled, self.new = n, []
        return self.table[at]


_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
     0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a 64-bit hash are usable."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` (at most 8) words; none if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k : k + n] * _MULTIPLIERS[k]
    return mixed(total)


def raw_texts(column) -> Iterator[bytes | None]:
    """The UTF-8 bytes of an Arrow string column one by one, null as None; the
    batch is not copied as a whole."""
    import pyarrow as pa

    view = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for i in range(len(view)):
        yield view[i].as_py()


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b)
