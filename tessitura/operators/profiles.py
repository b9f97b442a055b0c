"""Corpus profiles and distances, over long vectors (key, idx, value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import checkpoint
from .exact import exact_means
from .order import exact_median, exact_quantiles


def corpus_stats(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, idx, n, mean, median, std): population deviation, exact median, by
    radix selection; means and deviations are the same bits in any partitioning."""
    long = checkpoint(long.select(*by, "idx", "value"))
    keys = [*by, "idx"]
    means = exact_means(long, keys).select(*keys, "n", "mean", F.sqrt("var").alias("std"))
    return means.join(exact_median(long, keys, "value"), keys).select(*keys, "n", "mean", "median", "std")


def covariance(wide: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """(by, i, j, cov) for i <= j, sample covariance, zeros for one row.

    One aggregation over the wide vectors; the pairs become rows only after
    it, so nothing is joined with itself.
    """
    n = len(names)
    sums = [F.covar_samp(names[i], names[j]).alias(f"c_{i}_{j}") for i in range(n) for j in range(i, n)]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.coalesce(f"c_{i}_{j}", F.lit(0.0)).alias("cov")) for i in range(n) for j in range(i, n)])
    return wide.groupBy(*by).agg(*sums).select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def most_frequent(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value): the commonest value, ties by alphabet."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), value)).alias(value))


def guarded(std: Column, at_most: float = 1e-6) -> Column:
    """1 where a deviation is too small to divide by."""
    return F.when(std < at_most, F.lit(1.0)).otherwise(std)


def target_profile(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, idx, mean, std, total): the deviation guarded for division."""
    return long.groupBy(*by, "idx").agg(F.avg("value").alias("mean"), guarded(F.stddev_pop("value")).alias("std"), F.sum("value").alias("total"))


def fingerprints(members: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """(by, fingerprint): sha256 over the sorted distinct values of each field."""
    sets = F.struct(*[F.array_sort(F.collect_set(F.col(f).cast("string"))).alias(f) for f in fields])
    return members.groupBy(*by).agg(F.sha2(F.to_json(sets), 256).alias("fingerprint"))


def grouped_distance(long: DataFrame, profile: DataFrame, on: list[str], keys: list[str], root_mean: bool = True) -> DataFrame:
    """(keys, grp, distance): z-scores against the profile, by feature group:
    their root mean square, or with ``root_mean=False`` their norm."""
    z = (F.col("value") - F.col("mean")) / F.col("std")
    over = F.avg if root_mean else F.sum
    return long.join(profile, on).withColumn("_z", z * z).groupBy(*keys, "grp").agg(F.sqrt(over("_z")).alias("distance"))


def euclidean(a: DataFrame, b: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """(keys, distance) of two long vectors joined on ``on`` (idx among them)."""
    d = F.col("value") - F.col("value_b")
    return a.join(b.withColumnRenamed("value", "value_b"), on).groupBy(*keys).agg(F.sqrt(F.sum(d * d)).alias("distance"))


def pseudo_inverse(cov: np.ndarray) -> np.ndarray:
    """Of the symmetrised matrix; a feature-by-feature matrix, never data-sized."""
    return np.linalg.pinv((cov + cov.T) / 2)


def mahalanobis(a: Column, b: Column, inverse: np.ndarray) -> Column:
    """Distance of two array columns under a fixed inverse covariance."""
    d = F.zip_with(a, b, lambda x, y: x - y)
    rows = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in inverse])
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    square = dot(d, F.transform(rows, lambda row: dot(row, d)))
    return F.sqrt(F.greatest(square, F.lit(0.0)))


def iqr_outliers(rows: DataFrame, fields: list[str], key: str, by: list[str] | None = None, least: int = 4) -> DataFrame:
    """(by, field, key, value) outside 1.5 interquartile ranges; groups with
    fewer than ``least`` values have none."""
    by = by or []
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]))
    long = rows.select(key, *by, cells.alias("c")).select(key, *by, "c.*").where("value IS NOT NULL")
    long = checkpoint(long)
    q = exact_quantiles(long, [*by, "field"], "value", (0.25, 0.75)).where(F.col("n") >= least).withColumnRenamed("quantiles", "q")
    spread = F.col("q")[1] - F.col("q")[0]
    outside = (F.col("value") < F.col("q")[0] - 1.5 * spread) | (F.col("value") > F.col("q")[1] + 1.5 * spread)
    return long.join(q, [*by, "field"]).where(outside).select(*by, "field", key, "value")
