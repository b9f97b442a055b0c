"""Dense histograms, entropies and key profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import KEY_NAMES, ratio

# Krumhansl-Kessler key profiles, from the tonic on.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def histogram(rows: DataFrame, bin_: Column, size: int, key: str = "piece_id", weight: Column | None = None) -> DataFrame:
    """(key, values): array of ``size`` shares; zeros if nothing counts.

    One pass with a conditional sum per bin, so the shuffle carries one row per
    key and task, whatever the number of rows.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    marked = rows.select(key, bin_.cast("int").alias("_b"), w.alias("_w"))
    sums = marked.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("_b") == i, F.col("_w"))), F.lit(0.0)).alias(f"_{i}") for i in range(size)])
    return sums.select(key, normalised(F.array(*[f"_{i}" for i in range(size)])).alias("values"))


def normalised(counts: Column) -> Column:
    """Shares of the total; zeros stay zeros."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.transform(counts, lambda c: ratio(c, total))


def entropy(shares: Column) -> Column:
    """In bits; empty bins count nothing."""
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def pearson(x: Column, y: Column, n: int) -> Column:
    """Correlation of two arrays of length n; null if either is constant."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    dot = lambda a, b: add(F.zip_with(a, b, lambda u, v: u * v))
    mx, my = add(x) / n, add(y) / n
    cx, cy = F.transform(x, lambda v: v - mx), F.transform(y, lambda v: v - my)
    scale = F.sqrt(dot(cx, cx) * dot(cy, cy))
    return F.when(scale > 0, F.try_divide(dot(cx, cy), scale))


def key_profiles() -> list[tuple[int, str, list[float]]]:
    """(order, name, profile) of the 24 keys, majors first."""
    found = []
    for m, (mode, profile) in enumerate((("major", MAJOR), ("minor", MINOR))):
        for tonic in range(12):
            found.append((12 * m + tonic, f"{KEY_NAMES[tonic]} {mode}", [profile[(i - tonic) % 12] for i in range(12)]))
    return found


def key_correlations(shares: DataFrame, key: str = "piece_id", values: str = "values") -> DataFrame:
    """(key, key_order, key_name, r): correlation with each of the 24 profiles."""
    profiles = F.array(*[F.struct(F.lit(o).alias("key_order"), F.lit(n).alias("key_name"), F.array(*map(F.lit, p)).alias("p")) for o, n, p in key_profiles()])
    each = shares.select(key, values, F.explode(profiles).alias("k"))
    return each.select(key, "k.key_order", "k.key_name", pearson(F.col(values), F.col("k.p"), 12).alias("r"))


def estimated_key(shares: DataFrame, key: str = "piece_id", values: str = "values") -> DataFrame:
    """(key, key_name): the best correlated key, ties by order; C major if flat."""
    r = key_correlations(shares, key, values).where("r IS NOT NULL")
    best = r.groupBy(key).agg(F.min_by("key_name", F.struct(-F.round("r", 12), "key_order")).alias("key_name"))
    return shares.select(key).join(best, key, "left").na.fill("C major", ["key_name"])


def tonal_clarity(shares: DataFrame, key: str = "piece_id", values: str = "values") -> DataFrame:
    """(key, tonal_clarity): the best correlation itself, 0 if flat."""
    best = key_correlations(shares, key, values).groupBy(key).agg(F.max("r").alias("tonal_clarity"))
    return best.na.fill(0.0, ["tonal_clarity"])


def dense_bins(column: Column, edges: tuple[float, ...]) -> Column:
    """Index of the half-open bin between edges; below the first is bin 0."""
    found = F.lit(0)
    for i, edge in enumerate(edges):
        found = F.when(column >= edge, i + 1).otherwise(found)
    return found
