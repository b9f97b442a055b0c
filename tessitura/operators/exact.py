"""Sums of doubles that do not depend on the order of addition.

A value below ``2 ** top`` in size is cut into limbs, whole numbers of 40 bits
each on grids that ``top`` fixes. Limbs add up as decimals without rounding, in
any order and partitioning; three hold every bit that lies less than 120 bits
below ``2 ** top``. The total is rounded when the limbs are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 40
LIMBS = 3


def top_of(largest: Column) -> Column:
    """An exponent above a size; 0 for 0 or null."""
    return F.when(largest > 0, F.ceil(F.log2(largest)).cast("int") + 1).otherwise(0)


def _power(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))


def limbs(x: Column, top: Column) -> list[Column]:
    """The limbs of ``x``, as decimals; null adds nothing."""
    rest, found = x, []
    for k in range(1, LIMBS + 1):
        scale = _power(F.lit(BITS * k) - top)
        limb = F.rint(rest * scale)
        found.append(limb.cast("decimal(13,0)"))
        rest = rest - limb / scale
    return found


def joined(sums: list[Column], top: Column) -> Column:
    """The total, as a double, of summed limbs; the smallest are added first."""
    parts = [s.cast("double") * _power(top - F.lit(BITS * k)) for k, s in enumerate(sums, 1)]
    total = parts[-1]
    for p in reversed(parts[:-1]):
        total = p + total
    return total


def exact_sum(x: Column, top: Column) -> Column:
    """An aggregate: the sum of ``x``, null for no values. ``top`` is the same
    for all rows of a group and above :func:`top_of` of their largest size."""
    return joined([F.sum(limb) for limb in limbs(x, top)], F.max(top))


def exact_means(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, n, mean, var): count, mean and population variance of the values,
    the same bits in any partitioning. The variance is that of the distances
    from the mean, so nothing cancels."""
    x = F.col(value).cast("double")
    sizes = long.groupBy(*by).agg(F.max(F.abs(x)).alias("_large"), (F.max(x) - F.min(x)).alias("_range"), F.count(x).alias("n"))
    sizes = sizes.select(*by, "n", top_of(F.col("_large")).alias("_top"), (2 * top_of(F.col("_range"))).alias("_top2"))
    met = long.join(sizes, by)
    means = met.groupBy(*by).agg(exact_sum(x, F.col("_top")).alias("_sum"), F.max("n").alias("n")).select(*by, F.try_divide("_sum", "n").alias("mean"))
    gap = (x - F.col("mean")) * (x - F.col("mean"))
    return met.join(means, by).groupBy(*by).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), exact_sum(gap, F.col("_top2")).alias("_square")).select(*by, "n", "mean", F.try_divide("_square", "n").alias("var"))


def exact_covariances(wide: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """(by, n, means, cov): arrays of the means and, for i <= j row by row, of
    the sample covariances (0 for one row), the same bits in any partitioning.

    Three aggregations over long rows, each of one row a group and column after
    map-side combination: ranges, means, products of centred columns. Columns are
    rows, so that the plan is as long for many columns as for few.
    """
    k = len(names)
    vector = F.array(*[F.col(c).cast("double") for c in names])
    rows = wide.select(*by, vector.alias("_x"))
    long = rows.select(*by, F.posexplode("_x").alias("_i", "x"))
    x = F.col("x")
    sizes = long.groupBy(*by, "_i").agg(F.count("*").alias("n"), top_of(F.max(F.abs(x))).alias("_top"), top_of(F.max(x) - F.min(x)).alias("_range"))
    means = long.join(sizes, [*by, "_i"]).groupBy(*by, "_i").agg(F.max("n").alias("n"), F.max("_range").alias("_range"), (exact_sum(x, F.col("_top")) / F.max("n")).alias("m"))
    whole = means.groupBy(*by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("_i", "m", "_range"))).alias("_c"))  # a row a column
    whole = whole.select(*by, "n", F.col("_c.m").alias("means"), F.col("_c._range").alias("_ranges"))
    centred = rows.join(whole, by).withColumn("_d", F.zip_with("_x", "means", lambda x, m: x - m))
    of = lambda c, i: F.element_at(c, i + 1)
    pair = lambda i, j: F.struct((of("_d", i) * of("_d", j)).alias("x"), (of("_ranges", i) + of("_ranges", j)).alias("top"))
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.transform(F.sequence(i, F.lit(k - 1)), lambda j: pair(i, j))))
    products = centred.select(*by, "n", F.posexplode(cells).alias("p", "c")).groupBy(*by, "p", "n").agg(exact_sum(F.col("c.x"), F.col("c.top")).alias("s"))
    cov = products.select(*by, "p", F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).otherwise(0.0).alias("c"))
    packed = cov.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "c"))), lambda x: x["c"]).alias("cov"))
    return whole.select(*by, "n", "means").join(packed, by)
