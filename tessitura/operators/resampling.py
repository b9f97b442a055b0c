"""Resampling statistics with reproducible draws from hashes.

Rows are summed per cluster before anything is multiplied by the number of
resamples, so what grows is clusters times resamples.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_bits, hash_ordinal, ratio
from ..plans.checkpoints import checkpoint
from .order import exact_median


def numbered(df: DataFrame, n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def cluster_bootstrap(rows: DataFrame, value: str, stratum: str, cluster: str, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """(mean, low, high): clusters drawn with replacement within each stratum."""
    sums = rows.groupBy(stratum, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    order = Window.partitionBy(stratum).orderBy(cluster)
    placed = sums.withColumn("at", (F.row_number().over(order) - 1).cast("long")).withColumn("k", F.count("*").over(Window.partitionBy(stratum)))
    drawn = numbered(placed.select(stratum, "at", "k"), draws, "draw")
    picks = drawn.select(stratum, "draw", hash_ordinal(F.col("k"), F.lit(seed), F.col("draw"), F.col(stratum), F.col("at")).alias("at"))
    means = picks.join(placed, [stratum, "at"]).groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("m"))
    tail = (1 - level) / 2
    ends = means.agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    whole = rows.agg(F.avg(value).alias("mean"))
    return whole.join(F.broadcast(ends)).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def label_permutation_p(groups: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(observed, p): agreement of true and predicted labels when true labels
    are dealt among groups anew. ``groups``: (group_id, true_label,
    predicted_label, n)."""
    observed = groups.agg(ratio(F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0)), F.sum("n")).alias("observed"))
    names = groups.select("group_id", "true_label").distinct()
    each = numbered(names, permutations, "draw")
    w = Window.partitionBy("draw")
    own = each.withColumn("at", F.row_number().over(w.orderBy("group_id")))
    dealt = each.select("draw", F.col("true_label").alias("dealt"), F.row_number().over(w.orderBy(hash_bits(F.lit(seed), F.col("draw"), F.col("group_id")), "group_id")).alias("at"))
    moved = own.join(dealt, ["draw", "at"]).select("draw", "group_id", "dealt")
    scores = moved.join(groups.select("group_id", "predicted_label", "n"), "group_id").groupBy("draw").agg(ratio(F.sum(F.when(F.col("dealt") == F.col("predicted_label"), F.col("n")).otherwise(0)), F.sum("n")).alias("score"))
    beaten = scores.join(F.broadcast(observed)).agg(F.max("observed").alias("observed"), F.count_if(F.col("score") >= F.col("observed") - 1e-12).alias("k"))
    return beaten.select("observed", ((F.col("k") + 1) / F.lit(permutations + 1)).alias("p"))


def sign_permutation_p(rows: DataFrame, value: str, group: str, permutations: int, seed: int) -> DataFrame:
    """(mean, p): two-sided, signs of group means flipped by hash bits."""
    means = rows.groupBy(group).agg(F.avg(value).alias("m"))
    observed = means.agg(F.avg("m").alias("mean"))
    sign = F.when(hash_ordinal(F.lit(2), F.lit(seed), F.col("draw"), F.col(group)) == 0, F.lit(1.0)).otherwise(-1.0)
    flipped = numbered(means, permutations, "draw").withColumn("x", F.col("m") * sign).groupBy("draw").agg(F.avg("x").alias("x"))
    beaten = flipped.join(F.broadcast(observed)).agg(F.max("mean").alias("mean"), F.count_if(F.abs("x") >= F.abs("mean") - 1e-12).alias("k"))
    return beaten.select("mean", ((F.col("k") + 1) / F.lit(permutations + 1)).alias("p"))


def holm(rows: DataFrame, p: str, key: str, by: list[str] | None = None) -> DataFrame:
    """Adds p_adjusted: step-down, running maximum, at most 1."""
    by = by or []
    order = Window.partitionBy(*by).orderBy(p, key)
    n = F.count("*").over(Window.partitionBy(*by))
    raw = F.least(F.lit(1.0), (n - F.row_number().over(order) + 1) * F.col(p))
    return rows.withColumn("_raw", raw).withColumn("p_adjusted", F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def finite_stats(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, mean, std, median, min, max) of the finite values."""
    x = F.col(value).cast("double")
    good = rows.withColumn("_x", F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))
    good = checkpoint(good.withColumns({} if by else {"_all": F.lit(0)}).select(*(by := by or ["_all"]), "_x"))
    sums = good.groupBy(*by).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max"))
    return sums.join(exact_median(good, by, "_x"), by, "left").select(*[b for b in by if b != "_all"], "n", "mean", "std", "median", "min", "max")


def safe_correlation(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, r) over rows with both finite; null if either is constant."""
    fine = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = fine.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.covar_pop(a, b).alias("_c"), F.stddev_pop(a).alias("_a"), F.stddev_pop(b).alias("_b"))
    return sums.select(*(by or []), "n", F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.try_divide(F.col("_c"), F.col("_a") * F.col("_b"))).alias("r"))


def paired_t(rows: DataFrame, before: str, after: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, mean_difference, std_difference, t, p) of after - before."""
    d = rows.withColumn("_d", F.col(after) - F.col(before))
    sums = d.groupBy(*(by or [])).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean_difference"), F.stddev_samp("_d").alias("std_difference"))
    t = F.when(F.col("std_difference") > 0, F.try_divide(F.col("mean_difference"), F.col("std_difference") / F.sqrt("n")))
    return sums.withColumn("t", t).withColumn("p", t_test_p(F.col("t"), (F.col("n") - 1).cast("double")))


def signed_rank(rows: DataFrame, before: str, after: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, w_plus, w_minus, z, p): signed-rank sums with average ranks, and
    the normal approximation with a correction for ties."""
    by = by or []
    d = rows.withColumn("_d", F.col(after) - F.col(before)).where("_d <> 0").withColumn("_a", F.abs("_d"))
    w = Window.partitionBy(*by).orderBy("_a")
    same = Window.partitionBy(*by, "_a")
    ranked = d.withColumn("_t", F.count("*").over(same)).withColumn("_r", F.rank().over(w) + (F.col("_t") - 1) / 2)
    sums = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_r"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(F.col("_d") < 0, F.col("_r"))), F.lit(0.0)).alias("w_minus"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48.0)
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, spread)
    return sums.withColumn("z", z).withColumn("p", F.least(F.lit(1.0), 2 * normal_tail(F.abs("z")))).drop("_ties")


def _beta_cf(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else math.nan


def student_quantile(p: float, df: float) -> float:
    """t with a two-sided tail of ``1 - p`` by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_two_sided(mid, df) > 1 - p else (low, mid)
    return high


def t_test_p(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def p(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([student_two_sided(a, b) if a == a and b == b else None for a, b in zip(ts, dfs, strict=True)], dtype="float64")

    return p(t, df)


def t_quantile(df: Column, level: float = 0.95) -> Column:
    @F.pandas_udf("double")
    def q(dfs: pd.Series) -> pd.Series:
        known = {d: student_quantile(level, d) for d in set(dfs.dropna()) if d > 0}
        return dfs.map(lambda d: known.get(d, np.nan))

    return q(df)


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal, by a fixed rational fit (1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def survey_stats(responses: DataFrame, by: str = "dimension", level: float = 0.95) -> DataFrame:
    """(by, n, respondents, mean, std, low, high): t interval of the mean."""
    sums = responses.groupBy(by).agg(F.count("value").alias("n"), F.count_distinct("respondent_id").alias("respondents"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    half = t_quantile((F.col("n") - 1).cast("double"), level) * F.col("std") / F.sqrt("n")
    return sums.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def one_sample_t(responses: DataFrame, centre: float, by: str = "dimension", least: int = 20) -> DataFrame:
    """(by, n, t, p) where enough respondents answered."""
    sums = responses.groupBy(by).agg(F.count("value").alias("n"), F.count_distinct("respondent_id").alias("people"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).where(F.col("people") >= least)
    t = F.when(F.col("s") > 0, F.try_divide(F.col("m") - centre, F.col("s") / F.sqrt("n")))
    return sums.select(by, "n", t.alias("t"), t_test_p(t, (F.col("n") - 1).cast("double")).alias("p"))
