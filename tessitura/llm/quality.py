"""Quality by logistic regression on hashed word n-grams.

The features of a text are the hashed one- and two-word runs of its words and
of its words' shapes (runs of letters, capitals and digits collapsed), each
weighted by the root of its share. The weights come from per-coordinate
follow-the-regularised-leader updates over a bounded labelled sample; a score
is a sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONGEST, mixed, raw_texts, shipped
from .labelled import remainder, training_sample

BUCKETS = 1 << 18
#: Rows of the labelled sample: the documented bound of what the driver holds.
SAMPLE = 6000

_SHAPE = bytes.maketrans(
    bytes(range(97, 123)) + bytes(range(65, 91)) + bytes(range(48, 58)) + bytes(range(128, 256)),
    b"a" * 26 + b"A" * 26 + b"0" * 10 + b"a" * 128,
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


class _Pairs(dict):
    """word -> (hash of the word, hash of its shape), as one complex-free index
    into two growing lists; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 150_000) -> None:
        super().__init__()
        self.most = most
        self.words: list[int] = []
        self.shapes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        found = len(self.words)
        if len(word) <= LONGEST:
            self[word] = found
        self.words.append(xxhash.xxh3_64_intdigest(word.lower()))
        self.shapes.append(xxhash.xxh3_64_intdigest(_RUN.sub(rb"\1", word.translate(_SHAPE)), 1))
        return found


class Featurizer:
    """Sparse features (buckets, values) of a text; the values are 0 to 1."""

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.known = _Pairs()
        self.table = np.zeros((2, 1024), np.uint64)
        self.filled = 0

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split() if text else []
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(self.known.words) > self.known.most:
            self._reset()
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        n = len(self.known.words)
        if n > self.filled:
            while n > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], 1)
            self.table[0, self.filled : n] = self.known.words[self.filled :]
            self.table[1, self.filled : n] = self.known.shapes[self.filled :]
            self.filled = n
        word, shape = self.table[:, at]
        buckets, values = [], []
        for k, h in enumerate((word, word[:-1] * np.uint64(3) + word[1:], shape, shape[:-1] * np.uint64(5) + shape[1:])):
            if len(h):
                found, count = np.unique(mixed(h + np.uint64(k)) & np.uint64(BUCKETS - 1), return_counts=True)
                buckets.append(found.astype(np.int64))
                values.append(np.sqrt(count / len(h)))
        return np.concatenate(buckets), np.concatenate(values)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    shift: float

    def score(self, buckets: np.ndarray, values: np.ndarray) -> float:
        z = self.weights[buckets] @ values + self.bias + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, share: float, epochs: int = 5, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 3) -> QualityModel:
    """FTRL-proximal: z and n per coordinate, weights follow from them. The
    last coordinate is the bias. ``share`` (label 1's among all labelled rows)
    corrects for the balanced sample."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) > l1, w, 0.0)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y[i]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            # A bucket may stand for two families; their updates add up.
            np.add.at(z, at, g - sigma * w)
            np.add.at(n, at, g * g)
    every = weights(np.arange(BUCKETS + 1))
    mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return QualityModel(every[:-1], float(every[-1]), float(np.log(share / (1 - share)) - np.log(mean / (1 - mean))))


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> QualityModel:
    """Train on at most ``sample`` labelled rows outside the held-out fold.
    Without any, every text scores a half."""
    rows, share = training_sample(docs, labels, "quality", folds, held, sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Featurizer()
        for batch in batches:
            found = [of(t) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([b.astype("<i4").tobytes() for b, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                ["doc_id", "y", "buckets", "amounts"],
            )

    got = sorted(rows.select("doc_id", "text", "y").mapInArrow(features, "doc_id long, y int, buckets binary, amounts binary").collect())
    y = np.array([r.y for r in got], float)
    return train([(np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.amounts, "<f4").astype(float)) for r in got], y, share if len(y) else 0.5)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text), over whole
    texts. Null and empty texts get the score of no features. Other columns
    are ignored; rows may repeat."""
    load = shipped(docs.sparkSession, model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, of = load(), Featurizer()
        for batch in batches:
            scores = [model.score(*of(t)) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def quality_report(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted (score of ``at`` or more)."""
    return score_quality(docs, fit_quality(docs, labels)).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= at).cast("int").alias("predicted"),
    )
