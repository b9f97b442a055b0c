"""Paired tests chosen by the normality of the differences.

The Shapiro-Wilk statistic takes a weight from each value's rank, so it is one
window and one aggregation per group; its p-value is Royston's (1995), valid
from 3 to 5,000 values. The signed-rank test is exact for up to 50 differences
without ties or zeros, and the corrected normal approximation beyond.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resampling import paired_t, signed_rank

# Royston's polynomials, constant term first.
LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_MEAN, SMALL_SPREAD, SMALL_BOUND = (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322), (-2.273, 0.459)
LARGE_MEAN, LARGE_SPREAD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
#: The signed-rank distribution is counted out up to so many differences.
EXACT = 50


def _poly(c: tuple[float, ...], x):
    total = c[-1]
    for a in reversed(c[:-1]):
        total = total * x + a
    return total


def _normal_quantile(p: Column) -> Column:
    @F.pandas_udf("double")
    def q(ps: pd.Series) -> pd.Series:
        return ps.map(NormalDist().inv_cdf)

    return q(p)


def royston_p(w: float, n: int) -> float:
    """How likely normal values give a statistic of at most ``w``."""
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        bound = _poly(SMALL_BOUND, n)
        if y >= bound:
            return 1e-99
        y, mean, spread = -math.log(bound - y), _poly(SMALL_MEAN, n), math.exp(_poly(SMALL_SPREAD, n))
    else:
        mean, spread = _poly(LARGE_MEAN, math.log(n)), math.exp(_poly(LARGE_SPREAD, math.log(n)))
    return math.erfc((y - mean) / spread / math.sqrt(2)) / 2


def shapiro_wilk(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, w, p); ``w`` and ``p`` are null for fewer than 3 values and for
    equal ones. Null values don't count."""
    x = F.col(value).cast("double")
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(x)
    n = F.count("*").over(group)
    ranked = rows.where(x.isNotNull()).select(*by, x.alias("_x"), F.row_number().over(order).alias("_i"), n.alias("n"), F.avg(x).over(group).alias("_mean"))
    # Weights are odd about the middle: the upper half's are looked up for both.
    m = _normal_quantile((F.greatest("_i", F.col("n") + 1 - F.col("_i")) - 0.375) / (F.col("n") + 0.25))
    ranked = ranked.withColumn("_m", m).withColumn("_k", F.least("_i", F.col("n") + 1 - F.col("_i"))).withColumn("_sign", F.signum(2 * F.col("_i") - F.col("n") - 1))
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col("_m")))
    inner = lambda least: F.sum(F.when(F.col("_k") >= least, F.col("_sign") * F.col("_m") * F.col("_x")))
    spread = lambda k: F.sum(F.when(F.col("_k") == k, F.col("_sign") * F.col("_x")))
    sums = ranked.groupBy(*by, "n").agg(
        F.sum(F.col("_m") * F.col("_m")).alias("_mm"), at(1).alias("_m1"), F.coalesce(at(2), F.lit(0.0)).alias("_m2"),
        inner(2).alias("_in2"), inner(3).alias("_in3"), spread(1).alias("_s1"), F.coalesce(spread(2), F.lit(0.0)).alias("_s2"),
        F.sum((F.col("_x") - F.col("_mean")) * (F.col("_x") - F.col("_mean"))).alias("_ss"), (F.max("_x") > F.min("_x")).alias("_varies"),
    )
    u, size = 1 / F.sqrt(F.col("n").cast("double")), F.sqrt("_mm")
    a1 = F.when(F.col("n") == 3, math.sqrt(0.5)).otherwise(F.col("_m1") / size + _poly(LAST, u))
    a2 = F.col("_m2") / size + _poly(SECOND, u)
    few = F.sqrt((F.col("_mm") - 2 * F.col("_m1") * F.col("_m1")) / (1 - 2 * a1 * a1))
    many = F.sqrt((F.col("_mm") - 2 * F.col("_m1") * F.col("_m1") - 2 * F.col("_m2") * F.col("_m2")) / (1 - 2 * a1 * a1 - 2 * a2 * a2))
    top = F.when(F.col("n") == 3, a1 * F.col("_s1")).when(F.col("n") <= 5, a1 * F.col("_s1") + F.coalesce(F.col("_in2") / few, F.lit(0.0)))
    top = top.otherwise(a1 * F.col("_s1") + a2 * F.col("_s2") + F.coalesce(F.col("_in3") / many, F.lit(0.0)))
    w = F.when((F.col("n") >= 3) & F.col("_varies"), F.least(F.lit(1.0), F.try_divide(top * top, F.col("_ss"))))

    @F.pandas_udf("double")
    def p(ws: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([royston_p(a, int(k)) if a == a else None for a, k in zip(ws, ns, strict=True)], dtype="float64")

    return sums.select(*by, "n", w.alias("w")).withColumn("p", p("w", "n"))


@lru_cache(maxsize=64)
def rank_sum_counts(n: int) -> tuple[int, ...]:
    """How many of the 2^n sign patterns of ranks 1 to n give each positive sum."""
    counts = [1]
    for k in range(1, n + 1):
        counts = [a + b for a, b in zip(counts + [0] * k, [0] * k + counts, strict=True)]
    return tuple(counts)


def exact_signed_rank_p(n: int, smaller: float) -> float:
    """Two-sided, for the smaller of both rank sums."""
    return min(1.0, 2 * sum(rank_sum_counts(n)[: int(smaller) + 1]) / 2**n)


def chosen_tests(pairs: DataFrame, before: str, after: str, by: list[str], least: int = 10, alpha: float = 0.05) -> DataFrame:
    """(by, n, test, statistic, p, normality_p, significant), a row a group.

    Below ``least`` pairs there is no test: ``descriptive``, and null results.
    Differences whose normality is not refuted at ``alpha`` get the paired t
    test; others, constant ones too, the signed-rank test, whose statistic is
    the smaller rank sum; p is 1 where nothing differs. Pairs with a null don't
    count; groups without pairs are left out.
    """
    whole = pairs.where(F.col(before).isNotNull() & F.col(after).isNotNull()).withColumn("_gap", F.col(after) - F.col(before))
    normal = shapiro_wilk(whole, "_gap", by).select(*by, "n", F.col("p").alias("normality_p"))
    t = paired_t(whole, before, after, by).select(*by, F.col("t").alias("_t"), F.col("p").alias("_pt"))
    ranks = signed_rank(whole, before, after, by).select(*by, F.col("n").alias("_nonzero"), F.least("w_plus", "w_minus").alias("_w"), F.col("p").alias("_pw"))
    tied = whole.where("_gap <> 0").groupBy(*by, F.abs("_gap").alias("_a")).agg(F.count("*").alias("_c")).groupBy(*by).agg((F.max("_c") > 1).alias("_tied"))

    @F.pandas_udf("double")
    def exact(ns: pd.Series, ws: pd.Series) -> pd.Series:
        return pd.Series([exact_signed_rank_p(int(n), w) if n == n and n <= EXACT else None for n, w in zip(ns, ws, strict=True)], dtype="float64")

    met = normal.join(t, by, "left").join(ranks, by, "left").join(tied, by, "left")
    counted = (F.col("_nonzero") == F.col("n")) & ~F.col("_tied") & (F.col("n") <= EXACT)
    rank_p = F.coalesce(F.when(counted, exact("_nonzero", "_w")).otherwise(F.col("_pw")), F.lit(1.0))
    test = F.when(F.col("n") < least, "descriptive").when(F.coalesce(F.col("normality_p") > alpha, F.lit(False)), "paired t").otherwise("signed rank")
    met = met.withColumn("test", test)
    of = lambda a, b: F.when(F.col("test") == "paired t", a).when(F.col("test") == "signed rank", b)
    p = of(F.col("_pt"), rank_p)
    return met.select(*by, "n", "test", of(F.col("_t"), F.coalesce("_w", F.lit(0.0))).alias("statistic"), p.alias("p"), F.when(F.col("n") >= least, F.col("normality_p")).alias("normality_p"), (p < alpha).alias("significant"))
