"""Meter and tempo: as-of look-ups, bars, positions, lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio


def asof_last(rows: DataFrame, changes: DataFrame, values: list[str], key: str = "piece_id", at: str = "tick") -> DataFrame:
    """Each of ``rows`` with the ``values`` of the last change at or before it.

    A union and one window per key: no range join, and a change takes effect
    for rows at its own tick.
    """
    columns = rows.columns
    change = changes.select(key, at, F.lit(0).alias("_k"), *values)
    filled = rows.select(*columns, F.lit(1).alias("_k")).unionByName(change, allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy(at, "_k").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(*columns, "_k", *[F.last(v, ignorenulls=True).over(upto).alias(v) for v in values]).where("_k = 1").drop("_k")


def valid_meter(meter: DataFrame) -> DataFrame:
    """Positive signatures only; of several at one tick the last by value."""
    return meter.where("numerator > 0 AND denominator > 0")


def with_meter(rows: DataFrame, meter: DataFrame, key: str = "piece_id") -> DataFrame:
    """Rows with numerator, denominator and segment_tick in force; 4/4 from 0."""
    changes = valid_meter(meter).withColumn("segment_tick", F.col("tick"))
    found = asof_last(rows, changes, ["numerator", "denominator", "segment_tick"], key)
    return found.na.fill({"numerator": 4, "denominator": 4, "segment_tick": 0})


def positions(rows: DataFrame, meter: DataFrame, ticks_per_beat: int, key: str = "piece_id") -> DataFrame:
    """Adds bar_position and pulse_position in ticks times the denominator, and
    pulse_length in the same unit: whole numbers, so ratios are exact."""
    met = with_meter(rows, meter, key)
    elapsed = (F.col("tick") - F.col("segment_tick")) * F.col("denominator")
    pulse = F.lit(4 * ticks_per_beat)
    return (
        met.withColumn("pulse_length", pulse)
        .withColumn("bar_position", F.pmod(elapsed, pulse * F.col("numerator")))
        .withColumn("pulse_position", F.pmod(elapsed, pulse))
    )


def meter_segments(meter: DataFrame, ends: DataFrame, ticks_per_beat: int, key: str = "piece_id") -> DataFrame:
    """(key, segment_start, segment_end, numerator, denominator, bar_length):
    stretches of one meter up to the piece's end; 4/4 at 0 is implied."""
    given = meter.select(key, "tick", "numerator", "denominator")
    implied = ends.select(key, F.lit(0).cast("long").alias("tick")).join(given.select(key, "tick"), [key, "tick"], "left_anti")
    implied = implied.select(key, "tick", F.lit(4).alias("numerator"), F.lit(4).alias("denominator"))
    every = given.unionByName(implied).join(ends, key).where("tick <= end_tick")
    following = F.lead("tick").over(Window.partitionBy(key).orderBy("tick"))
    return every.select(
        key,
        F.col("tick").alias("segment_start"),
        F.least(F.coalesce(following, F.col("end_tick")), F.col("end_tick")).alias("segment_end"),
        "numerator",
        "denominator",
        (F.floor(F.lit(4 * ticks_per_beat) * F.col("numerator") / F.col("denominator"))).cast("long").alias("bar_length"),
    )


def meter_problems(meter: DataFrame, ticks_per_beat: int) -> DataFrame:
    """Signatures that no bar grid can follow: not positive, a denominator that
    is no power of two, or a bar of no whole number of ticks."""
    bad = (F.col("numerator") <= 0) | (F.col("denominator") <= 0) | (F.bit_count("denominator") != 1)
    uneven = F.try_mod(F.lit(4 * ticks_per_beat) * F.col("numerator"), F.col("denominator")) != 0
    return meter.where(bad | uneven)


def bars(meter: DataFrame, ends: DataFrame, ticks_per_beat: int, key: str = "piece_id") -> DataFrame:
    """(key, bar_index, bar_start, bar_end, numerator, denominator), bars cut
    off where a segment or the piece ends."""
    segments = meter_segments(meter, ends, ticks_per_beat, key).where("segment_end > segment_start")
    starts = segments.withColumn("bar_start", F.explode(F.sequence("segment_start", F.col("segment_end") - 1, "bar_length")))
    numbered = F.row_number().over(Window.partitionBy(key).orderBy("bar_start")) - 1
    return starts.select(
        key, numbered.alias("bar_index"), "bar_start", F.least(F.col("bar_start") + F.col("bar_length"), "segment_end").alias("bar_end"), "numerator", "denominator"
    )


def notes_in_bars(notes: DataFrame, meter: DataFrame, ticks_per_beat: int, key: str = "piece_id") -> DataFrame:
    """Notes with the bar that holds their onset; after the last bar, that one."""
    from .intervals import end_ticks

    every = bars(meter, end_ticks(notes, key), ticks_per_beat, key).withColumn("tick", F.col("bar_start"))
    return asof_last(notes, every, ["bar_index", "bar_start", "bar_end"], key)


def length_in_bars(meter: DataFrame, ends: DataFrame, ticks_per_beat: int, key: str = "piece_id") -> DataFrame:
    """(key, length_bars): fractional, aware of meter changes; 0-length bars skipped."""
    segments = meter_segments(valid_meter(meter), ends, ticks_per_beat, key)
    share = (F.col("segment_end") - F.col("segment_start")) * F.col("denominator") / (F.lit(4.0 * ticks_per_beat) * F.col("numerator"))
    return segments.groupBy(key).agg(F.sum(share).alias("length_bars"))


def empty_bar_ratio(notes: DataFrame, meter: DataFrame, ticks_per_beat: int, key: str = "piece_id") -> DataFrame:
    """(key, bar_count, empty_bar_ratio): bars that no sounding note touches.

    Each note is dealt to the bars between those of its first and last tick,
    by index; no range join.
    """
    from .intervals import end_ticks

    every = bars(meter, end_ticks(notes, key), ticks_per_beat, key)
    at = every.select(key, F.col("bar_start").alias("tick"), "bar_index")
    sounding = notes.where("duration_ticks > 0")
    ends = sounding.select(key, F.monotonically_increasing_id().alias("n"), F.explode(F.array(F.struct(F.col("tick").alias("tick"), F.lit(0).alias("side")), F.struct((F.col("tick") + F.col("duration_ticks") - 1).alias("tick"), F.lit(1).alias("side")))).alias("e")).select(key, "n", "e.*")
    found = asof_last(ends, at, ["bar_index"], key)
    spans = found.groupBy(key, "n").agg(F.min("bar_index").alias("first"), F.max("bar_index").alias("last"))
    touched = spans.select(key, F.explode(F.sequence("first", "last")).alias("bar_index")).distinct().groupBy(key).agg(F.count("*").alias("occupied"))
    counts = every.groupBy(key).agg(F.count("*").alias("bar_count")).join(touched, key, "left").na.fill(0, ["occupied"])
    return counts.select(key, "bar_count", ratio(F.col("bar_count") - F.col("occupied"), F.greatest("bar_count", F.lit(1))).alias("empty_bar_ratio"))


def duration_seconds(ends: DataFrame, tempo: DataFrame, ticks_per_beat: int, key: str = "piece_id") -> DataFrame:
    """(key, duration_s): the tempo map integrated to the end; 120 BPM before
    the first event."""
    changes = tempo.select(key, "tick", "tempo")
    start = ends.select(key, F.lit(0).cast("long").alias("tick"), F.lit(500000).alias("tempo")).withColumn("_p", F.lit(0))
    every = start.unionByName(changes.withColumn("_p", F.lit(1))).join(ends, key).where("tick <= end_tick")
    until = F.coalesce(F.lead("tick").over(Window.partitionBy(key).orderBy("tick", "_p")), F.col("end_tick"))
    part = (until - F.col("tick")) * F.col("tempo") / F.lit(ticks_per_beat * 1e6)
    return every.withColumn("_s", part).groupBy(key).agg(F.sum("_s").alias("duration_s"))


def mean_tempo(pieces: DataFrame, tempo: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, tempo_bpm): unweighted mean of the tempo events, 120 without any."""
    found = tempo.where("tempo > 0").groupBy(key).agg(F.avg(60e6 / F.col("tempo")).alias("tempo_bpm"))
    return pieces.select(key).join(found, key, "left").na.fill(120.0, ["tempo_bpm"])


def seconds_at(rows: DataFrame, tempo: DataFrame, ticks_per_beat: int, key: str = "piece_id") -> DataFrame:
    """Adds second: the tempo map integrated to each row's tick; 120 BPM before
    the first event. Each change carries the seconds up to it, so a row needs
    the last change only."""
    w = Window.partitionBy(key).orderBy("tick")
    last = tempo.groupBy(key, "tick").agg(F.max("tempo").alias("tempo"))
    gap = F.col("tick") - F.coalesce(F.lag("tick").over(w), F.lit(0))
    part = gap * F.coalesce(F.lag("tempo").over(w), F.lit(500000)) / F.lit(ticks_per_beat * 1e6)
    changes = last.withColumn("_part", part).withColumn("_at", F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_from", F.col("tick"))
    met = asof_last(rows, changes.select(key, "tick", "tempo", "_at", "_from"), ["tempo", "_at", "_from"], key).na.fill({"tempo": 500000, "_at": 0.0, "_from": 0})
    return met.withColumn("second", F.col("_at") + (F.col("tick") - F.col("_from")) * F.col("tempo") / F.lit(ticks_per_beat * 1e6)).drop("tempo", "_at", "_from")
