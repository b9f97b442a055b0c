"""Sparse pianorolls and segments: cells, runs, decoding, cell losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, half_even, ratio

LOW, HIGH = 24, 108
STEPS_PER_BAR, BARS_PER_SEGMENT = 16, 4


def cells(notes: DataFrame, ticks_per_step: int, steps: int, key: str = "piece_id") -> DataFrame:
    """(key, step, pitch): active cells of a window of ``steps`` from 0; every
    note has one step at least."""
    start = half_even(F.col("tick") / ticks_per_step)
    end = F.greatest(half_even((F.col("tick") + F.col("duration_ticks")) / ticks_per_step), start + 1)
    within = notes.where(F.col("pitch").between(LOW, HIGH - 1)).select(key, "pitch", F.greatest(start, F.lit(0)).alias("s"), F.least(end, F.lit(steps)).alias("e")).where("s < e")
    return within.select(key, "pitch", F.explode(F.sequence("s", F.col("e") - 1)).alias("step")).distinct()


def runs(active: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, pitch, start, end): stretches of consecutive active steps."""
    w = Window.partitionBy(key, "pitch").orderBy("step")
    islands = active.withColumn("_i", F.col("step") - F.row_number().over(w))
    return islands.groupBy(key, "pitch", "_i").agg(F.min("step").alias("start"), (F.max("step") + 1).alias("end")).drop("_i")


def nearest_voices(found: DataFrame, template: DataFrame, key: str = "piece_id") -> DataFrame:
    """Runs with channel and velocity of the nearest template note of their
    pitch. The candidates on either side come from two as-of windows over the
    union, so nothing is joined by pitch alone."""
    order = Window.partitionBy(key, "pitch").orderBy("at", "_k", "velocity", "channel")
    voice = F.struct("at", "velocity", "channel")
    a = template.groupBy(key, "pitch", F.col("start").alias("at")).agg(F.min(F.struct("velocity", "channel")).alias("v")).select(key, "pitch", "at", F.lit(0).alias("_k"), "v.velocity", "v.channel", F.lit(None).cast("long").alias("end"))
    b = found.select(key, "pitch", F.col("start").alias("at"), F.lit(1).alias("_k"), F.lit(None).cast("int").alias("velocity"), F.lit(None).cast("int").alias("channel"), "end")
    both = a.unionByName(b).withColumn("_v", F.when(F.col("_k") == 0, voice))
    before = F.last("_v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_v", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = F.array_min(F.filter(F.array(*[F.when(x.isNotNull(), F.struct(F.abs(x["at"] - F.col("at")).alias("d"), x["at"].alias("at"), x["velocity"].alias("velocity"), x["channel"].alias("channel"))) for x in (before, after)]), lambda x: x.isNotNull()))
    return both.select(key, "pitch", F.col("at").alias("start"), "end", "_k", near.alias("n")).where("_k = 1").select(key, "pitch", "start", "end", F.col("n.velocity").alias("velocity"), F.col("n.channel").alias("channel"))


def template_defaults(notes: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, velocity, channel): median velocity, commonest channel."""
    counts = notes.groupBy(key, "channel").agg(F.count("*").alias("n"))
    common = counts.groupBy(key).agg(F.min_by("channel", F.struct(-F.col("n"), "channel")).alias("channel"))
    middle = notes.groupBy(key).agg(clamp(half_even(F.percentile("velocity", F.lit(0.5))), 1, 127).cast("int").alias("velocity"))
    return middle.join(common, key)


def step_of(tick: Column, start: Column, length: Column) -> Column:
    """Nearest of a bar's step boundaries, ties to the lower."""
    boundary = lambda k: start + half_even(length * k / STEPS_PER_BAR)
    ranked = F.transform(F.sequence(F.lit(0), F.lit(STEPS_PER_BAR)), lambda k: F.struct(F.abs(tick - boundary(k)).alias("d"), k.alias("k")))
    return F.array_min(ranked)["k"]


def note_segments(notes: DataFrame, bars: DataFrame, key: str = "piece_id") -> DataFrame:
    """(note fields, segment): every segment of four bars a note sounds in."""
    from .meter import asof_last

    starts = bars.select(key, F.col("bar_start").alias("tick"), "bar_index")
    marked = notes.withColumn("_n", F.monotonically_increasing_id())
    ends = F.explode(F.array(F.col("tick"), F.greatest(F.col("tick"), F.col("tick") + F.col("duration_ticks") - 1)))
    found = asof_last(marked.select(key, "_n", ends.alias("tick")), starts, ["bar_index"], key)
    spans = found.groupBy(key, "_n").agg(F.min("bar_index").alias("a"), F.max("bar_index").alias("b"))
    seg = lambda c: F.floor(F.col(c) / BARS_PER_SEGMENT)
    dealt = spans.select(key, "_n", F.explode(F.sequence(seg("a"), seg("b"))).alias("segment"))
    return marked.join(dealt, [key, "_n"]).drop("_n")


def quantisation_errors(notes: DataFrame, bars: DataFrame, key: str = "piece_id") -> DataFrame:
    """Notes with onset_step and onset_error (ticks off the step's boundary)."""
    from .meter import asof_last

    at = bars.select(key, F.col("bar_start").alias("tick"), "bar_index", "bar_start", (F.col("bar_end") - F.col("bar_start")).alias("bar_length"))
    met = asof_last(notes, at, ["bar_index", "bar_start", "bar_length"], key)
    step = step_of(F.col("tick"), F.col("bar_start"), F.col("bar_length"))
    met = met.withColumn("onset_step", step)
    return met.withColumn("onset_error", F.abs(F.col("tick") - F.col("bar_start") - half_even(F.col("bar_length") * F.col("onset_step") / STEPS_PER_BAR)))


def frame_cleanup(frames: DataFrame, onsets: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, pitch, step): frames that an onset of their own run precedes; an
    onset is a frame. State carries over segment borders: steps are global."""
    w = Window.partitionBy(key, "pitch").orderBy("step")
    every = frames.select(key, "pitch", "step", F.lit(0).alias("o")).unionByName(onsets.select(key, "pitch", "step", F.lit(1).alias("o"))).groupBy(key, "pitch", "step").agg(F.max("o").alias("o"))
    islands = every.withColumn("_i", F.col("step") - F.row_number().over(w))
    run = Window.partitionBy(key, "pitch", "_i").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn("_seen", F.max("o").over(run)).where("_seen = 1").select(key, "pitch", "step")


def binary_f1(predicted: Column, actual: Column) -> Column:
    tp = F.count_if(predicted & actual)
    return ratio(2 * tp, F.count_if(predicted) + F.count_if(actual))


def threshold_grid(scored: DataFrame, grid: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, threshold, f1, chosen): F1 at each threshold in one pass; the best
    is chosen, then the nearest to one half. ``scored``: (probability, actual)."""
    by = by or []
    sums = scored.groupBy(*by).agg(*[binary_f1(F.col("probability") >= t, F.col("actual")).alias(f"f{i}") for i, t in enumerate(grid)])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"f{i}").alias("f1")) for i, t in enumerate(grid)]))
    long = sums.select(*by, each.alias("x")).select(*by, "x.*")
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.round("f1", 12).desc(), F.round(F.abs(F.col("threshold") - 0.5), 12), "threshold")
    return long.withColumn("chosen", F.row_number().over(order) == 1)


def positive_weights(counts: DataFrame, active: str, total: str, most: float, by: list[str]) -> DataFrame:
    """(by, weight): negatives a positive, from 1 to ``most``."""
    sums = counts.groupBy(*by).agg(F.sum(active).alias("_p"), F.sum(total).alias("_t"))
    return sums.select(*by, F.coalesce(clamp(F.try_divide((F.col("_t") - F.col("_p")).cast("double"), F.col("_p")), 1.0, float(most)), F.lit(float(most))).alias("weight"))


def masked_l1(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, loss) of (predicted, actual, weight, mask) cells."""
    w = F.col("weight") * F.col("mask")
    return cells.groupBy(*by).agg((F.sum(F.abs(F.col("predicted") - F.col("actual")) * w) / F.greatest(F.sum(w), F.lit(1.0))).alias("loss"))
