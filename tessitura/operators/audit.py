"""Audits, gates, reports and loss formulas as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import half_even, ratio
from ..plans.checkpoints import checkpoint
from .order import exact_median
from .resampling import finite_stats, paired_t, signed_rank


def lower_quantile(rows: DataFrame, by: list[str], value: str, share: float, into: str) -> DataFrame:
    """(by, into): the element at ``int(share * (n - 1))`` of the sorted values,
    without interpolation. Rows are counted per distinct value first, so the
    window runs over distinct values; ticks have few."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    upto = F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).withColumn("_at", F.floor(F.lit(share) * (F.sum("_n").over(group) - 1)) + 1)
    return placed.where("_upto >= _at").groupBy(*by).agg(F.min(value).alias(into))


def audit_counts(notes: DataFrame, by: list[str], error: str) -> DataFrame:
    """(by, notes, zero_length, mean_error, p95_error) per split and label."""
    sums = notes.groupBy(*by).agg(F.count("*").alias("notes"), F.count_if(F.col("duration_ticks") <= 0).alias("zero_length"), F.avg(error).alias("mean_error"))
    return sums.join(lower_quantile(notes, by, error, 0.95, "p95_error"), by)


def meter_counts(meter: DataFrame) -> DataFrame:
    return meter.groupBy("numerator", "denominator").agg(F.count("*").alias("n"))


def record_summary(records: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean_delta, median_delta, positive, fallback_rate, all_valid) of
    task records (delta, fallback, valid); ``by`` may be empty."""
    records = checkpoint(records.withColumns({} if by else {"_all": F.lit(0)}).select(*(keys := by or ["_all"]), "delta", "fallback", "valid"))
    sums = records.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("positive"),
        F.avg(F.col("fallback").cast("double")).alias("fallback_rate"), F.bool_and("valid").alias("all_valid"),
    )
    return sums.join(exact_median(records, keys, "delta", "median_delta"), keys, "left").select(*by, "n", "mean_delta", "median_delta", "positive", "fallback_rate", "all_valid")


def direction(source: Column, target: Column) -> Column:
    return F.concat_ws("→", source, target)


def at_bounds(genes: DataFrame, gene: str, low: float, high: float, eps: float = 1e-9) -> DataFrame:
    """(low_share, high_share): how often a gene stands at its bounds."""
    share = lambda edge: F.avg((F.abs(F.col(gene) - edge) <= eps).cast("double"))
    return genes.agg(share(low).alias("low_share"), share(high).alias("high_share"))


def selection_key(valid: Column, content: Column, fallback: Column, diversity: Column, style: Column) -> Column:
    """Compares as (valid, content, -fallback, diversity, style)."""
    return F.struct(valid.cast("int").alias("valid"), content.alias("content"), (-fallback).alias("fallback"), diversity.alias("diversity"), style.alias("style"))


def allowed_length_error(bars: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, allowed_ticks): a sixteenth of the longest bar, 1 at least."""
    return bars.groupBy(key).agg(F.greatest(F.lit(1), F.max(half_even((F.col("bar_end") - F.col("bar_start")) / 16))).alias("allowed_ticks"))


def sane_outputs(source: DataFrame, output: DataFrame, most_voices: int, key: str = "piece_id") -> DataFrame:
    """(key, note_ratio, sane): a quarter to four times the notes, pitches in
    range and chords of ``most_voices`` at most."""
    a = source.groupBy(key).agg(F.count("*").alias("na"))
    chords = output.groupBy(key, "tick").agg(F.count("*").alias("size"), F.min("pitch").alias("low"), F.max("pitch").alias("high"))
    b = chords.groupBy(key).agg(F.sum("size").alias("nb"), F.max("size").alias("voices"), F.min("low").alias("low"), F.max("high").alias("high"))
    met = a.join(b, key, "left").na.fill(0, ["nb", "voices"])
    fine = (F.col("nb") > 0) & F.col("note_ratio").between(0.25, 4.0) & (F.col("voices") <= most_voices) & (F.col("low") >= 0) & (F.col("high") <= 127)
    return met.withColumn("note_ratio", ratio(F.col("nb"), F.col("na"))).select(key, "note_ratio", F.coalesce(fine, F.lit(False)).alias("sane"))


def too_few_files(files: DataFrame, artist: str, least: int) -> DataFrame:
    return files.groupBy(artist).agg(F.count("*").alias("n")).where(F.col("n") < least)


def objective_report(distances: DataFrame, series: list[str], before: str, after: str, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Statistics of each distance series, and the paired tests of before and
    after, which have no rows under ``least`` pairs."""
    long = distances.select(F.explode(F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).cast("double").alias("value")) for s in series])).alias("x")).select("x.*")
    stats = finite_stats(long, "value", ["series"])
    pairs = distances.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    t = paired_t(pairs, before, after).select(F.lit("paired t").alias("test"), "n", F.col("t").alias("statistic"), "p")
    w = signed_rank(pairs, before, after).select(F.lit("signed rank").alias("test"), "n", F.col("z").alias("statistic"), "p")
    return stats, t.unionByName(w).where(F.col("n") >= least)


def least_squares_adversarial(score: Column, real: bool) -> Column:
    """Mean squared distance of scores to 1 (real) or 0."""
    return F.avg((score - (1.0 if real else 0.0)) * (score - (1.0 if real else 0.0)))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Mean of -log softmax at the label; logits are arrays, shifted by their
    largest so that no exponential overflows."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.avg(F.log(total) + top - F.element_at(logits, (label + 1).cast("int")))


def mean_absolute(a: Column, b: Column) -> Column:
    return F.avg(F.abs(a - b))


def weighted_sum(terms: dict[str, float]) -> Column:
    """Of loss columns by name."""
    return sum((F.col(name) * weight for name, weight in terms.items()), F.lit(0.0))
