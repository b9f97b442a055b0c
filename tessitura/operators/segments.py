"""Datasets of segments: splits, eligibility, index, stitching back to notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import half_even
from .pianoroll import BARS_PER_SEGMENT, HIGH, LOW, STEPS_PER_BAR


def split_roles(splits: DataFrame, repeat: int, fold: int, inner: int) -> DataFrame:
    """(piece_id, split): inner train and validation, outer test, of one
    protocol. ``splits``: (repeat, fold, inner_fold or null, role, piece_id)."""
    at = splits.where((F.col("repeat") == repeat) & (F.col("fold") == fold))
    inside = at.where((F.col("inner_fold") == inner) & F.col("role").isin("train", "validation"))
    outside = at.where(F.col("inner_fold").isNull() & (F.col("role") == "test"))
    return inside.unionByName(outside).select("piece_id", F.col("role").alias("split"))


def eligible(members: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Split members that no audit excludes."""
    return members.join(exclusions.select("piece_id").distinct(), "piece_id", "left_anti")


def fit_scope(members: DataFrame, evaluated: str) -> DataFrame:
    """The pieces a model may be fitted on: train for validation, train and
    validation for test."""
    return members.where(F.col("split").isin("train", *(["validation"] if evaluated == "test" else [])))


def segment_index(members: DataFrame, cells: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(index, problems): segments with a cell, of pieces with a known label;
    repeated pieces, other labels and groups in several splits are problems.

    ``members``: (piece_id, group_id, label, split); ``cells``: (piece_id, segment).
    """
    twice = members.groupBy("piece_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("piece_id").cast("string").alias("key"), F.lit("repeated piece").alias("problem"))
    strange = members.where(~F.col("label").isin(*labels)).select(F.col("piece_id").cast("string").alias("key"), F.lit("unknown label").alias("problem"))
    crossing = members.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.col("group_id").cast("string").alias("key"), F.lit("group crosses splits").alias("problem"))
    index = members.where(F.col("label").isin(*labels)).join(cells.select("piece_id", "segment").distinct(), "piece_id")
    return index.select("piece_id", "group_id", "label", "split", "segment"), twice.unionByName(strange).unionByName(crossing)


def segment_counts(bars: DataFrame, index: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, segments, nonempty): windows of four bars, and those with a cell."""
    every = bars.groupBy(key).agg((F.floor(F.max("bar_index") / BARS_PER_SEGMENT) + 1).alias("segments"))
    filled = index.groupBy(key).agg(F.count_distinct("segment").alias("nonempty"))
    return every.join(filled, key, "left").na.fill(0, ["nonempty"])


def label_index(labels: DataFrame, label: str) -> DataFrame:
    """(label, index): distinct labels by alphabet, from 0. A short list."""
    distinct = labels.select(label).distinct()
    return distinct.withColumn("index", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))


def grid(bars: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, step, cell_start, cell_end): sixteen cells a bar, numbered through
    the piece; boundaries are rounded to ticks."""
    length = F.col("bar_end") - F.col("bar_start")
    edge = lambda k: F.col("bar_start") + half_even(length * k / STEPS_PER_BAR)
    dealt = bars.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(STEPS_PER_BAR - 1))))
    return dealt.select(key, (F.col("bar_index") * STEPS_PER_BAR + F.col("k")).alias("step"), edge(F.col("k")).alias("cell_start"), edge(F.col("k") + 1).alias("cell_end"))


def stitched(onsets: DataFrame, frames: DataFrame, bars: DataFrame, source: DataFrame, ends: DataFrame, key: str = "piece_id") -> DataFrame:
    """Notes of the segments of whole pieces, laid end to end.

    ``onsets``, ``frames``: (key, pitch, step), steps as in the :func:`grid` of
    ``bars``. A note begins at each onset and lasts until the next onset of its
    pitch, the first cell without a frame, or the piece's end; notes without
    length go. Its voice is the nearest source note's of that pitch, by
    distance, then tick, then channel. Source notes out of range pass unchanged.
    """
    marks = onsets.select(key, "pitch", "step", F.lit(1).alias("o"), F.lit(0).alias("f")).unionByName(frames.select(key, "pitch", "step", F.lit(0).alias("o"), F.lit(1).alias("f")))
    every = marks.groupBy(key, "pitch", "step").agg(F.max("o").alias("o"), F.max("f").alias("f"))
    return decoded(every.where("f = 1"), bars, source, ends, key)


def decoded(frames: DataFrame, bars: DataFrame, source: DataFrame, ends: DataFrame, key: str = "piece_id") -> DataFrame:
    """As :func:`stitched`, of frames (key, pitch, step, o): ``o`` is 1 where an
    onset is. Bars and cells are many times the rows that they are made of, so
    that a join may broadcast them by mistake; bars are looked up as of their
    index, and a bar tells the boundaries of its cells."""
    from .meter import asof_last

    at = bars.select(key, "bar_index", F.struct(F.col("bar_index").alias("i"), "bar_start", (F.col("bar_end") - F.col("bar_start")).alias("length")).alias("bar"))
    every = asof_last(frames.select(key, "pitch", "step", "o", F.floor(F.col("step") / STEPS_PER_BAR).cast("int").alias("bar_index")), at, ["bar"], key, "bar_index")
    edge = lambda k: F.col("bar.bar_start") + half_even(F.col("bar.length") * k / STEPS_PER_BAR)
    k = F.col("step") - F.col("bar_index") * STEPS_PER_BAR
    every = every.where("bar.i = bar_index").select(key, "pitch", "step", "o", edge(k).alias("tick"), edge(k + 1).alias("until"))
    w = Window.partitionBy(key, "pitch").orderBy("step")
    # A run of frames; a cell without one ends what sounds, an onset there too.
    island = every.withColumn("run", F.col("step") - F.row_number().over(w))
    of_run = Window.partitionBy(key, "pitch", "run").orderBy("step")
    voiced = island.withColumn("note", F.sum("o").over(of_run.rowsBetween(Window.unboundedPreceding, 0))).where("note > 0")
    spans = voiced.groupBy(key, "pitch", "run", "note").agg(F.min("tick").alias("tick"), F.max("until").alias("until"))
    timed = spans.join(ends, key).withColumn("duration_ticks", F.least("until", "end_tick") - F.col("tick")).where("duration_ticks > 0")
    inside = source.where(F.col("pitch").between(LOW, HIGH - 1))
    # The nearest source note: the last at or before, and the first after.
    voice = F.struct("at", "channel", "velocity")
    a = inside.groupBy(key, "pitch", F.col("tick").alias("at")).agg(F.min(F.struct("channel", "velocity")).alias("v")).select(key, "pitch", "at", F.lit(0).alias("k"), "v.channel", "v.velocity", F.lit(None).cast("long").alias("duration_ticks"))
    b = timed.select(key, "pitch", F.col("tick").alias("at"), F.lit(1).alias("k"), F.lit(None).cast("int").alias("channel"), F.lit(None).cast("int").alias("velocity"), "duration_ticks")
    both = a.unionByName(b).withColumn("v", F.when(F.col("k") == 0, voice))
    order = Window.partitionBy(key, "pitch").orderBy("at", "k")
    before = F.last("v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first("v", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = F.array_min(F.array_compact(F.array(*[F.when(x.isNotNull(), F.struct(F.abs(x["at"] - F.col("at")).alias("d"), x["at"].alias("at"), x["channel"].alias("channel"), x["velocity"].alias("velocity"))) for x in (before, later)])))
    found = both.withColumn("near", near).where("k = 1")
    notes = found.select(key, F.col("at").alias("tick"), F.coalesce("near.channel", F.lit(0)).alias("channel"), "pitch", F.coalesce("near.velocity", F.lit(64)).alias("velocity"), "duration_ticks")
    return notes.unionByName(source.where(~F.col("pitch").between(LOW, HIGH - 1)).select(*notes.columns))


def end_errors(notes: DataFrame, bars: DataFrame, key: str = "piece_id") -> DataFrame:
    """Sounding notes in range with end_error (ticks from the note's end to the
    boundary that follows it in the bar where it ends), and the widths of a
    step where it begins and ends."""
    from .meter import asof_last

    at = bars.select(key, F.col("bar_start").alias("tick"), "bar_start", (F.col("bar_end") - F.col("bar_start")).alias("bar_length"))
    inside = notes.where(F.col("pitch").between(LOW, HIGH - 1) & (F.col("duration_ticks") > 0))
    met = asof_last(inside, at, ["bar_start", "bar_length"], key).withColumnsRenamed({"tick": "onset", "bar_start": "_s", "bar_length": "_l"})
    met = asof_last(met.withColumn("tick", F.col("onset") + F.col("duration_ticks") - 1), at, ["bar_start", "bar_length"], key).withColumn("end", F.col("tick") + 1)
    edges = F.transform(F.sequence(F.lit(0), F.lit(STEPS_PER_BAR)), lambda k: F.col("bar_start") + half_even(F.col("bar_length") * k / STEPS_PER_BAR))
    decoded = F.coalesce(F.array_min(F.filter(edges, lambda x: x >= F.col("end"))), F.array_max(edges))
    return met.select(key, F.col("onset").alias("tick"), "pitch", "duration_ticks", (decoded - F.col("end")).alias("end_error"), (F.col("_l") / STEPS_PER_BAR).alias("start_step_width"), (F.col("bar_length") / STEPS_PER_BAR).alias("end_step_width"))


def step_at(tick: Column, bar: Column) -> Column:
    """The cell of a bar (i, bar_start, length) that holds ``tick``, as
    :func:`grid` numbers and rounds; the last with ticks if it lies behind."""
    d, length = F.least(tick - bar["bar_start"], bar["length"] - 1), bar["length"]
    # The last k with half_even(length * k / 16) <= d; a tie goes to the even tick.
    k, tie = F.floor((STEPS_PER_BAR * d + STEPS_PER_BAR // 2) / length), (STEPS_PER_BAR * d + STEPS_PER_BAR // 2) % length == 0
    k = F.least(F.when(tie & (d % 2 == 1), k - 1).otherwise(k), F.lit(STEPS_PER_BAR - 1))
    return (bar["i"] * STEPS_PER_BAR + k).cast("int")


def frame_steps(notes: DataFrame, bars: DataFrame, key: str = "piece_id") -> DataFrame:
    """As :func:`frame_cells` over the :func:`grid` of ``bars``, without it: a
    note's bars are looked up, its cells follow from them."""
    from .meter import asof_last

    at = bars.select(key, F.col("bar_start").alias("tick"), F.struct(F.col("bar_index").alias("i"), "bar_start", (F.col("bar_end") - F.col("bar_start")).alias("length")).alias("bar"))
    inside = notes.where(F.col("pitch").between(LOW, HIGH - 1) & (F.col("duration_ticks") > 0))
    met = asof_last(inside.select(key, "pitch", "tick", (F.col("tick") + F.col("duration_ticks") - 1).alias("last")), at, ["bar"], key)
    met = met.select(key, "pitch", step_at(F.col("tick"), F.col("bar")).alias("first"), F.col("last").alias("tick"))
    met = asof_last(met, at, ["bar"], key).select(key, "pitch", "first", step_at(F.col("tick"), F.col("bar")).alias("last"))
    dealt = met.select(key, "pitch", "first", F.explode(F.sequence("first", "last")).alias("step"))
    return dealt.groupBy(key, "pitch", "step").agg(F.max(F.col("first") == F.col("step")).alias("onset"))


def frame_cells(notes: DataFrame, cells: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, pitch, step): grid cells that begin before a note's end and end
    after its start, and those (with first) that hold an onset. The cells at
    both ends come from an as-of look-up, those between from their numbers.
    Where a bar has fewer ticks than cells, cells without ticks share their
    start with one that has some; no note is looked up in them."""
    from .meter import asof_last

    at = cells.where("cell_end > cell_start").select(key, F.col("cell_start").alias("tick"), "step")
    inside = notes.where(F.col("pitch").between(LOW, HIGH - 1) & (F.col("duration_ticks") > 0))
    met = asof_last(inside.select(key, "pitch", "tick", (F.col("tick") + F.col("duration_ticks") - 1).alias("last")), at, ["step"], key).select(key, "pitch", F.col("step").alias("first"), F.col("last").alias("tick"))
    met = asof_last(met, at, ["step"], key)
    dealt = met.select(key, "pitch", "first", F.explode(F.sequence("first", "step")).alias("step"))
    return dealt.groupBy(key, "pitch", "step").agg(F.max(F.col("first") == F.col("step")).alias("onset"))
