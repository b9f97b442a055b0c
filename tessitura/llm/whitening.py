"""Whitening of embeddings by their principal components.

Entries become whole numbers, so counts and sums are exact. The covariance is
the Gramian of exactly centred rows, from Spark MLlib's ``RowMatrix``, over the
number of rows; its eigenvectors are found on the driver, where they are no
larger than the number of dimensions squared, and broadcast to whiten the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, staged

STEPS = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Entries from here on do not fit into a long after scaling.
LARGEST = 2.0**53
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def valid_rows(rows: DataFrame, steps: int = STEPS, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole: not null or empty, no null
    and no non-finite entry. ``x`` holds ``floor(steps * entry) + offset``."""
    whole = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)
    entries = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    entries = entries.where((F.size("v") > 0) & F.forall("v", whole))
    return entries.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(steps))) + F.lit(offset)).alias("x"))


def _matrix(column) -> np.ndarray:
    """A list column without nulls, of one length, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (n, sums) a task, the sums as text, since they may pass a long."""
    n, total = 0, None
    for batch in batches:
        if len(batch):
            x = _matrix(batch.column("x"))
            # Halves of 32 bits: no sum of a batch can overflow.
            part = (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
            n, total = n + len(x), part if total is None else total + part
    if n:
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": [[str(v) for v in total]]})


def gramian(vectors: DataFrame, column: str, rows: int, dims: int) -> np.ndarray:
    """Sum of the outer products of an array<double> column, by ``RowMatrix``."""
    ml = vectors.select(array_to_vector(column).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(ml, "v"), rows, dims).computeGramianMatrix().toArray()


class Whitening:
    """Exact means and the components of a fit list, for tasks to apply."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, most: int) -> None:
        self.n = n
        self.near = np.array([round(s / n) if abs(s) < 2**50 else s // n for s in sums], np.int64)
        self.rest = [s - n * int(m) for s, m in zip(sums, self.near, strict=True)]  # below n in size
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        least = max(values[0], 0) * len(values) * np.finfo(float).eps * 16
        kept = min(most, int((values > least).sum()))
        vectors = vectors[:, :kept]
        top = np.abs(vectors).argmax(0)
        self.axes = vectors * np.where(vectors[top, np.arange(kept)] < 0, -1.0, 1.0)
        self.scale = 1 / np.sqrt(values[:kept])
        self.explained = values[:kept] / np.trace(covariance) if kept else values[:0]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.axes) * self.scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - S) ** 2``; null where no long holds it."""
        near = x - self.near
        largest = self.n * int(np.abs(near).max(initial=0)) + self.n
        if largest * largest * x.shape[1] < 2**63:
            return ((self.n * near - np.array(self.rest, np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * near.astype(object) - np.array(self.rest, object)) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in exact]


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The components of a table of distinct vectors ``x``; None if it is empty.
    The driver sees one row of sums a task and the covariance."""
    parts = fit.select("x").mapInArrow(_sums, "n long, s array<string>").collect()
    if not parts:
        return None
    n, sums = sum(p.n for p in parts), [sum(map(int, column)) for column in zip(*(p.s for p in parts), strict=True)]
    near = [round(s / n) if abs(s) < 2**50 else s // n for s in sums]
    rest = [(s - n * m) / n for s, m in zip(sums, near, strict=True)]
    means, rests = F.array(*map(F.lit, near)), F.array(*map(F.lit, rest))
    centred = F.zip_with(F.zip_with("x", means, lambda x, m: (x - m).cast("double")), rests, lambda x, r: x - r)
    return Whitening(n, sums, gramian(fit.select(centred.alias("c")), "c", n, len(sums)) / n, components)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus
    the identity, measured on the rows."""
    kept = len(model.scale)
    if not kept:
        return 0.0

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"w": pa.FixedSizeListArray.from_arrays(model.whitened(_matrix(batch.column("x"))).ravel(), kept).cast(pa.list_(pa.float64()))})

    # A column of ones beside them: the same pass gives their means.
    rows = fit.select("x").mapInArrow(whiten, "w array<double>").select(F.concat("w", F.array(F.lit(1.0))).alias("w"))
    g = gramian(rows, "w", model.n, kept + 1) / model.n
    return float(np.abs(g[:-1, :-1] - np.outer(g[-1, :-1], g[-1, :-1]) - np.eye(kept)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS, steps: int = STEPS, offset: int = OFFSET) -> DataFrame:
    """Whitened components of every row of ``rows`` (vec_id, embedding).

    Rows whose vector is null or empty, or has a null or non-finite entry, are
    left out, as are entries of 2^53 and more and vectors of another length
    than most rows have (of equally frequent lengths the longer one counts).
    Components are fitted on the distinct vectors, so copies change nothing;
    each row, null and repeated ids too, comes with its own rows of the result.
    Where the fit list varies in fewer directions than ``components``, there
    are only so many components: none for one vector. An empty table gives no
    rows; other columns are ignored.

    Returns vec_id, component (from 1, by falling variance; the largest entry
    of its axis is positive), n, deviation (exact; null beyond a long),
    whitened, explained, identity_error.
    """
    spark = rows.sparkSession
    valid = valid_rows(rows, steps, offset)
    lengths = valid.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if lengths is None:
        return spark.createDataFrame([], _RESULT)
    valid = valid.where(F.size("x") == lengths.length)
    fit = staged(valid.select("x").distinct())
    model = fit_whitening(fit, components)
    error = identity_error(fit, model)
    packed = shipped(spark, model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = packed()
        kept = len(model.scale)
        for batch in batches:
            x = _matrix(batch.column("x"))
            each = lambda column: column.take(pa.array(np.repeat(np.arange(len(x)), kept)))  # noqa: B023, E731
            count = len(x) * kept
            yield pa.RecordBatch.from_arrays(
                [
                    each(batch.column("vec_id")), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))), pa.array(np.full(count, model.n)),
                    each(pa.array(model.deviations(x), pa.int64())), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(count, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return valid.mapInArrow(apply, _RESULT)
