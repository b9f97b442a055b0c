"""Melody: skyline, successive differences, contours, n-grams, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio


def skyline(notes: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, tick, pitch): the highest pitch of every onset."""
    return notes.groupBy(key, "tick").agg(F.max("pitch").alias("pitch"))


def successive(rows: DataFrame, value: Column, name: str, key: str = "piece_id", order: str = "tick") -> DataFrame:
    """Adds ``name``: a value minus the one before it; null for the first."""
    return rows.withColumn(name, value - F.lag(value).over(Window.partitionBy(key).orderBy(order)))


def ngrams(rows: DataFrame, value: str, n: int, key: str = "piece_id", order: str = "tick") -> DataFrame:
    """(key, g0 .. g{n-1}): every run of n successive values."""
    w = Window.partitionBy(key).orderBy(order)
    grams = rows.select(key, order, F.col(value).alias("g0"), *[F.lead(value, k).over(w).alias(f"g{k}") for k in range(1, n)])
    return grams.where(F.col(f"g{n - 1}").isNotNull()).select(key, *[f"g{k}" for k in range(n)])


def ngram_stats(grams: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, repeat_ratio, vocabulary_ratio)."""
    parts = [c for c in grams.columns if c != key]
    vocabulary = ratio(F.count_distinct(*parts), F.count("*"))
    return grams.groupBy(key).agg(vocabulary.alias("vocabulary_ratio")).withColumn("repeat_ratio", 1 - F.col("vocabulary_ratio"))


def contour(notes: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, tick, sign): direction of the skyline into each onset but the first."""
    steps = successive(skyline(notes, key), F.col("pitch"), "step", key)
    return steps.where("step IS NOT NULL").select(key, "tick", F.signum("step").cast("int").alias("sign"))


def best_lag(rows: DataFrame, value: str, key: str = "piece_id", order: str = "tick", lags: int = 8) -> DataFrame:
    """(key, best_lag_similarity): the largest share of values that equal the
    one ``lag`` places before, over lags 1 to ``lags``."""
    w = Window.partitionBy(key).orderBy(order)
    same = rows.select(key, *[(F.col(value) == F.lag(value, k).over(w)).cast("double").alias(f"l{k}") for k in range(1, lags + 1)])
    means = same.groupBy(key).agg(*[F.avg(f"l{k}").alias(f"l{k}") for k in range(1, lags + 1)])
    return means.select(key, F.coalesce(F.greatest(*[f"l{k}" for k in range(1, lags + 1)]), F.lit(0.0)).alias("best_lag_similarity"))


NOTE_FIELDS = ("tick", "channel", "pitch", "velocity", "duration_ticks")


def duplicate_ordinals(notes: DataFrame, key: str = "piece_id") -> DataFrame:
    """Adds ``ordinal``: the number of a note among its equals, from 0."""
    same = Window.partitionBy(key, *NOTE_FIELDS).orderBy(F.lit(0))
    return notes.withColumn("ordinal", F.row_number().over(same) - 1)


def melody_flags(notes: DataFrame, key: str = "piece_id") -> DataFrame:
    """Adds ordinal, ``is_melody`` (the top note of the onset; of several, the
    first by its fields) and ``ambiguous`` (several notes share the top pitch)."""
    w = Window.partitionBy(key, "tick")
    order = w.orderBy(F.col("pitch").desc(), "channel", "velocity", "duration_ticks", "ordinal")
    top = F.max("pitch").over(w)
    flagged = duplicate_ordinals(notes, key).withColumn("is_melody", F.row_number().over(order) == 1)
    return flagged.withColumn("ambiguous", F.sum((F.col("pitch") == top).cast("int")).over(w) > 1)
