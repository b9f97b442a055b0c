"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the embeddings of the word and of its beginnings,
each hashed into one table. Filters of several widths slide over the words,
the largest response of each filter over the whole text (max pooling) feeds a
logistic output. Every labelled row is trained on: rows lie in shards, each task
takes the common parameters through its shard in numpy, and the changes are
averaged; word odds, calibration and thresholds come from counts over all rows.
Decision thresholds are calibrated by language; the score never sees it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONGEST, checkpointed, partitions, raw_texts, shipped
from .labelled import labelled_ids, remainder

BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
BEGINNINGS = (4, 5, 6)
EDGES = b".,;:!?%&$*#|\"'()[]{}<>-_/\\"
#: Labelled rows, and bytes of their texts, in a shard: what a task holds of them.
SHARD, SHARD_BYTES = 16_000, 1 << 26
#: Passes over all labelled rows: as many as make so many steps in a shard,
#: between these bounds.
EPOCHS, LEAST_EPOCHS, STEPS_IN_SHARD = 8, 2, 25_600
#: Labelled doc_ids that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 21
PAD = 0
#: Words pooled at once: long texts take no more memory than this many.
STRETCH = 1 << 16
#: Steps of a rounded model's numbers in one unit.
STEPS = 1 << 14
#: Steps of a parameter's change, so that sums are exact, and of a row's output.
FIXED, OUTPUT_STEPS = 1 << 32, 1 << 8
AMOUNTS = [f"c{i}" for i in range(2 * DIM)]


def word_rows(word: bytes) -> list[int]:
    """Rows of the embedding table whose sum is the word's vector; row 0 is zero."""
    bare = word.strip(EDGES)
    if not bare:
        return [PAD] * (1 + len(BEGINNINGS))
    rows = [xxhash.xxh3_64_intdigest(bare) % (BUCKETS - 1) + 1]
    return rows + [xxhash.xxh3_64_intdigest(bare[:k], 1) % (BUCKETS - 1) + 1 if len(bare) > k else PAD for k in BEGINNINGS]


class _Rows(dict):
    """word -> its index in ``table``; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 60_000) -> None:
        super().__init__()
        self.most, self.table = most, []

    def __missing__(self, word: bytes) -> int:
        found = len(self.table)
        if len(word) <= LONGEST:
            self[word] = found
        self.table.append(word_rows(word))
        return found

    def of(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass
class ToxicityModel:
    """Embeddings, filters by width, output weights, and calibration."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Per word, what it adds to each filter at each of the filter's taps.
        Of a rounded model this is exact: the same for a word in any company."""
        vectors = self.embed[rows].sum(1)
        return np.concatenate([vectors @ f[k] for f in self.filters for k in range(len(f))], 1)

    def rounded(self) -> ToxicityModel:
        """Embeddings and filters as multiples of ``1 / STEPS`` below 2^7: sums of
        products are then whole multiples of ``STEPS ** -2`` below 2^53, which
        doubles add without error in any order."""
        whole = lambda x: np.clip(np.rint(x.astype(np.float64) * STEPS) / STEPS, -128, 128)
        return replace(self, embed=whole(self.embed), filters=[whole(f) for f in self.filters], bias=self.bias.astype(np.float64), out=self.out.astype(np.float64))

    def pooled(self, per_word: np.ndarray) -> np.ndarray:
        return _pool(per_word)[0]

    def score(self, pooled: np.ndarray) -> float:
        z = (np.maximum(pooled + self.bias, 0) * self.out[:-1]).sum() + self.out[-1]
        return float(1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30))))


def _pool(per_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter and where; texts are padded with zeros."""
    n, at, best, where = len(per_word), 0, [], []
    for width in WIDTHS:
        length = max(n - width + 1, 1)
        total = np.zeros((length, FILTERS), per_word.dtype)
        for k in range(width):
            piece = per_word[k : k + length, at : at + FILTERS]
            total[: len(piece)] += piece
            at += FILTERS
        spot = total.argmax(0)
        where.append(spot)
        best.append(total[spot, np.arange(FILTERS)])
    return np.concatenate(best), np.concatenate(where)


def _pool_in_stretches(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The largest responses over the rows ``at`` of a table, a stretch at a
    time; stretches overlap, so that every window of words lies in one."""
    overlap = max(WIDTHS) - 1
    best = None
    for start in range(0, max(len(at) - overlap, 1), STRETCH):
        found = _pool(table[at[start : start + STRETCH + overlap]])[0]
        best = found if best is None else np.maximum(best, found)
    return best


def _seen(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Documents of label 0 and 1 with each embedding row; they add up."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for rows, label in zip(docs, y, strict=True):
        seen[int(label), np.unique(rows)] += 1
    return seen


def _log_odds(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smoothed log odds of label 1 of each embedding row, by documents with it;
    ``n``: documents of label 0 and 1."""
    n = np.maximum(n, 1)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    return np.where(seen.sum(0) >= 4, odds, 0.0)


class _Fit:
    """Parameters in training and their Adagrad sums, as two tables of ``DIM``
    columns: a row per embedding, then one per tap of a filter, then bias and
    output. Taps lie by width, place and filter, as in ``responses``."""

    #: The filter of each tap, and its place in the filter.
    FILTER = np.concatenate([np.tile(np.arange(j * FILTERS, (j + 1) * FILTERS), w) for j, w in enumerate(WIDTHS)])
    PLACE = np.concatenate([np.repeat(np.arange(w), FILTERS) for w in WIDTHS])

    def __init__(self, odds: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        last = -(-(2 * len(WIDTHS) * FILTERS + 1) // DIM)
        self.now = np.zeros((BUCKETS + len(self.FILTER) + last, DIM), np.float32)
        self.past = np.full_like(self.now, 0.1)
        embed, taps, _, out = self.parts(self.now)
        embed[:] = rng.normal(0, 0.05, embed.shape)
        embed[:, 0] = np.clip(odds, -2, 6) / 4
        embed[PAD] = 0
        taps[:] = rng.normal(0, 0.2, taps.shape)
        first = self.FILTER % FILTERS == 0
        taps[first, 0] = 1.0 / np.array(WIDTHS)[self.FILTER[first] // FILTERS]
        out[:-1:FILTERS] = 1.0
        out[-1] = -1.0

    @classmethod
    def parts(cls, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Views of embeddings, taps, bias and output."""
        taps, n = BUCKETS + len(cls.FILTER), len(WIDTHS) * FILTERS
        tail = table[taps:].reshape(-1)
        return table[:BUCKETS], table[BUCKETS:taps], tail[:n], tail[n : 2 * n + 1]

    def model(self) -> ToxicityModel:
        embed, taps, bias, out = self.parts(self.now)
        ends = np.cumsum(WIDTHS) * FILTERS
        filters = [taps[e - w * FILTERS : e].reshape(w, FILTERS, DIM).transpose(0, 2, 1) for w, e in zip(WIDTHS, ends, strict=True)]
        return ToxicityModel(embed, filters, bias, out)

    def epoch(self, docs: list[np.ndarray], y: np.ndarray, order: np.ndarray, epoch: int) -> None:
        """One Adagrad step per document, in ``order``."""
        embed, taps, bias, out = self.parts(self.now)
        past_embed, past_taps, past_bias, past_out = self.parts(self.past)
        rate = 0.05 / (1 + epoch / 3)

        def step(x: np.ndarray, g: np.ndarray, sums: np.ndarray, rate: float, at=slice(None)) -> None:
            sums[at] += g * g
            x[at] -= rate * g / np.sqrt(sums[at])

        for i in order:
            rows = docs[i]
            if not len(rows):
                continue
            best, where = _pool(embed[rows].sum(1) @ taps.T)
            hidden = np.maximum(best + bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ out[:-1] + out[-1], -30, 30)))
            error = np.float32(p - y[i])
            back = error * out[:-1] * (best + bias > 0)
            step(out, error * np.append(hidden, np.float32(1)) + 1e-4 * out, past_out, rate)
            step(bias, back, past_bias, rate)
            at = where[self.FILTER] + self.PLACE
            ok = at < len(rows)
            met = rows[np.minimum(at, len(rows) - 1)]
            b = (back[self.FILTER] * ok)[:, None]
            grads = np.repeat((taps * b)[ok], rows.shape[1], 0)
            step(taps, embed[met].sum(1) * b + 1e-4 * taps, past_taps, rate)
            ids, inverse = np.unique(met[ok].ravel(), return_inverse=True)
            g = np.zeros((len(ids), DIM), np.float32)
            np.add.at(g, inverse, grads)
            step(embed, g[ids != PAD] + 1e-3 * embed[ids[ids != PAD]], past_embed, rate / 5, ids[ids != PAD])

    def changed(self, before: _Fit) -> tuple[np.ndarray, np.ndarray]:
        """Rows that changed, and by how much in steps of ``1 / FIXED``."""
        change = np.concatenate([self.now.astype(float) - before.now, self.past.astype(float) - before.past], 1)
        at = np.flatnonzero(change.any(1))
        return at, np.rint(change[at] * FIXED).astype(np.int64)

    def add(self, at: np.ndarray, change: np.ndarray) -> None:
        self.now[at] += change[:, :DIM].astype(np.float32)
        self.past[at] += change[:, DIM:].astype(np.float32)


def _outputs(model: ToxicityModel, docs: list[np.ndarray]) -> np.ndarray:
    """The rounded output of each document, in whole steps."""
    pooled = [model.pooled(model.responses(r)) if len(r) else np.zeros(len(model.bias)) for r in docs]
    z = np.array([np.maximum(x + model.bias, 0) @ model.out[:-1] + model.out[-1] for x in pooled])
    return np.rint(np.clip(z, -30, 30) * OUTPUT_STEPS).astype(np.int64)


def _finish(model: ToxicityModel, z: np.ndarray, y: np.ndarray, check: np.ndarray, langs: np.ndarray, n: np.ndarray, share: float) -> ToxicityModel:
    """Calibration and thresholds, from ``n`` rows of each kind of output ``z``."""
    mean = (n * y).sum() / n.sum()
    _calibrate(model, z, y, np.where(check, n, 0) if n[check].sum() >= 20 else n, mean, share)
    scores = 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -30, 30)))
    weight = n * np.where(y == 1, share / max(mean, 1e-9), (1 - share) / max(1 - mean, 1e-9))
    model.threshold = _best_threshold(scores, y, weight)
    for lang in {x for x in langs if x is not None}:
        of = np.array([x == lang for x in langs])
        if min(n[of & (y == 1)].sum(), n[of & (y == 0)].sum()) >= 10:
            model.thresholds[lang] = _best_threshold(scores[of], y[of], weight[of])
    return model


def train(docs: list[np.ndarray], y: np.ndarray, share: float, langs: list[str | None], epochs: int = EPOCHS, seed: int = 5) -> ToxicityModel:
    """``docs``: embedding rows by word, one array of shape (words, 4) each.

    The first embedding dimension starts from the log odds of a row; Adagrad
    then trains embeddings, filters and output on the rest; ``share`` (label
    1's among all labelled rows) corrects for a balanced sample.
    """
    fit = _Fit(_log_odds(_seen(docs, y), np.bincount(y.astype(int), minlength=2)), seed)
    check = np.arange(len(docs)) % 5 == 4  # for calibration; not trained on
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        fit.epoch(docs, y, rng.permutation(np.flatnonzero(~check)), epoch)
    model = fit.model().rounded()
    return _finish(model, _outputs(model, docs) / OUTPUT_STEPS, y, check, np.array(langs, object), np.ones(len(y)), share)


def _calibrate(model: ToxicityModel, z: np.ndarray, y: np.ndarray, n: np.ndarray, mean: float, share: float) -> None:
    """Logistic scale and shift on rows not trained on, then the true share."""
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, w = n * (p - y), n * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * z**2).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        d = np.linalg.solve(h, [(g * z).sum() + (a - 1), g.sum() + 0.1 * b])
        a, b = a - np.clip(d[0], -0.5, 0.5), b - np.clip(d[1], -0.5, 0.5)
    mean, share = np.clip(mean, 1e-3, 1 - 1e-3), np.clip(share, 1e-3, 1 - 1e-3)
    model.scale, model.shift = float(a), float(b + np.log(share / (1 - share)) - np.log(mean / (1 - mean)))


def _best_threshold(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap below the score at which F1 is best."""
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum((y * weight)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (y * weight).sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores are told apart by no threshold
    best = int(f1.argmax())
    return float((s[best] + s[min(best + 1, len(s) - 1)]) / 2)


def labelled_words(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> DataFrame:
    """(shard, doc_id, words, lang, y, check) of every labelled row outside the
    held-out fold, cut from its lineage. Of texts that repeat a doc_id the one
    that hashes lowest counts, and shards go by doc_id, so reruns agree however
    the tables are dealt. ``check`` marks the fifth that calibrates."""
    known = labelled_ids(labels, "toxic", folds, held)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = known.count()
    every, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(-(-rows // SHARD), -(-size * min(rows, every) // max(every, 1) // SHARD_BYTES), 1)
    met = texts.join(F.broadcast(known) if rows <= BROADCAST_ROWS else known, "doc_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = _Rows()
            found = [known.of(t) for t in raw_texts(batch.column(1))]
            table = np.array(known.table or [word_rows(b"")], "<u2")
            packed = pa.array([table[i].tobytes() for i in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, *batch.columns[2:]], ["doc_id", "words", "lang", "y", "hash"])

    cut = met.select("doc_id", "text", "lang", "y", F.xxhash64("text").alias("hash")).mapInArrow(words, "doc_id long, words binary, lang string, y int, hash long")
    placed = cut.withColumns({"shard": F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"), "check": F.pmod(F.xxhash64("doc_id", F.lit("check")), F.lit(5)) == 4})
    one = F.min(F.struct("hash", "words", "lang", "y", "check")).alias("one")
    kept = placed.repartition(partitions(docs.sparkSession), "shard").groupBy("shard", "doc_id").agg(one)
    return checkpointed(kept.select("shard", "doc_id", "one.words", "one.lang", "one.y", "one.check"))


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    """Embedding rows by word of each document; nothing is copied."""
    return [np.frombuffer(w.as_buffer() if len(w.as_buffer()) else b"", "<u2").reshape(-1, 1 + len(BEGINNINGS)) for w in column]


def _columns(found: pa.Table) -> list[np.ndarray]:
    return [c.to_numpy() for c in found.columns]


def _training(load: Callable[[], _Fit], epoch: int, seed: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """What one pass over a shard changes of the parameters that ``load`` gives."""

    def run(key: tuple, shard: pa.Table) -> pa.Table:
        before, after = load(), load()
        order = np.argsort(shard["doc_id"].to_numpy())
        order = np.random.default_rng([seed, epoch, key[0].as_py()]).permutation(order[~shard["check"].to_numpy()[order]])
        after.epoch(_unpacked(shard["words"].combine_chunks()), shard["y"].to_numpy().astype(np.float32), order, epoch)
        at, change = after.changed(before)
        return pa.table([pa.array(at), *map(pa.array, change.T)], ["at", *AMOUNTS])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, seed: int = 5) -> ToxicityModel:
    """Train on every labelled row outside the held-out fold.

    The driver sees tables of fixed size: counts and changes by embedding row,
    and numbers of rows by output and language. A parameter's change is the mean
    over the shards that changed it. Without labels of both kinds, every text
    scores label 1's share.
    """
    spark = docs.sparkSession
    rows = labelled_words(docs, labels, folds, held)
    n = np.zeros(2)
    for y, count in rows.groupBy("y").agg(F.count("*")).collect():
        n[y] = count
    if not n.all():
        share = labelled_ids(labels, "toxic", folds, held).agg(F.avg("y")).first()[0] or 0.0
        flat = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        share = min(max(share, 1e-6), 1 - 1e-6)
        return ToxicityModel(
            np.zeros((BUCKETS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], flat, np.zeros(len(flat) + 1, np.float32), 0.0, float(np.log(share / (1 - share)))
        )

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            total += _seen(_unpacked(batch.column(0)), batch.column(1).to_numpy())
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["at", "n0", "n1"])

    by_row = rows.select("words", "y").mapInArrow(seen, "at long, n0 long, n1 long").groupBy("at").agg(F.sum("n0"), F.sum("n1"))
    at, *sums = _columns(by_row.toArrow())
    total = np.zeros((2, BUCKETS), np.int64)
    total[:, at] = sums
    fit = _Fit(_log_odds(total, n), seed)

    steps = n.sum() / max(rows.agg(F.count_distinct("shard")).first()[0], 1)
    for epoch in range(min(max(math.ceil(STEPS_IN_SHARD / steps), LEAST_EPOCHS), EPOCHS)):
        changes = rows.groupBy("shard").applyInArrow(_training(shipped(spark, fit), epoch, seed), ", ".join(f"{c} long" for c in ("at", *AMOUNTS)))
        at, shards, *change = _columns(changes.groupBy("at").agg(F.count("*"), *map(F.sum, AMOUNTS)).toArrow())
        fit.add(at, np.stack(change, 1) / FIXED / shards[:, None])

    model = fit.model().rounded()
    load_model = shipped(spark, model)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_outputs(model, _unpacked(batch.column(0))), pa.int64()), *batch.columns[1:]], ["z", "y", "check", "lang"])

    kinds = rows.select("words", "y", "check", "lang").mapInArrow(outputs, "z long, y int, check boolean, lang string").groupBy("z", "y", "check", "lang").agg(F.count("*").alias("n"))
    z, y, check, langs, counts = _columns(kinds.orderBy("z", "y", "check", "lang").toArrow())
    return _finish(model, z / OUTPUT_STEPS, y.astype(float), check.astype(bool), langs, counts.astype(float), n[1] / n.sum())


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The columns ``keep``, score and toxic of every row of ``docs`` (doc_id,
    text, lang), over whole texts. Null and empty texts get the score of no
    words; ``toxic`` compares with the threshold of the row's language, or the
    common one if the language is null or had too few labels. Rows may repeat."""
    load = shipped(docs.sparkSession, model)  # of fixed size
    names = list(dict.fromkeys((*keep, "text", "lang")))  # a text travels once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        known, table, filled = _Rows(), np.zeros((1024, sum(WIDTHS) * FILTERS)), 0
        for batch in batches:
            scores = []
            for text in raw_texts(batch.column(names.index("text"))):
                if len(known.table) > known.most:
                    known, filled = _Rows(), 0
                at = known.of(text)
                if len(known.table) > filled:
                    while len(known.table) > len(table):
                        table = np.concatenate([table, np.zeros_like(table)])
                    table[filled : len(known.table)] = model.responses(np.array(known.table[filled:]))
                    known.table[filled:] = [None] * (len(known.table) - filled)
                    filled = len(known.table)
                scores.append(model.score(_pool_in_stretches(table, at)))
            limit = [model.thresholds.get(x, model.threshold) for x in batch.column(names.index("lang")).to_pylist()]
            toxic = [s >= t for s, t in zip(scores, limit, strict=True)]
            own = [batch.column(names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(scores, pa.float64()), pa.array(toxic, pa.bool_())], [*keep, "score", "toxic"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*names).withColumns({c: F.col(c).cast("string") for c in ("text", "lang")}).mapInArrow(run, f"{types}, score double, toxic boolean")


def toxicity_report(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (score of ``at`` or more), toxic."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= at).cast("int").alias("predicted"),
        "toxic",
    )
