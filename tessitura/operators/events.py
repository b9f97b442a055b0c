"""Raw events: pairing of note-ons and note-offs, ordering, delta times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_notes(raw: DataFrame, stream: list[str], track: list[str], order: str = "seq", ends: DataFrame | None = None) -> DataFrame:
    """(stream, start_seq, end_seq, ...): first-in-first-out pairing.

    ``raw`` has one row per note-on (d = 1) or note-off (d = -1) with tick. An
    off without an open note is dropped; an on without a partner ends at the
    last tick of its track, which ``ends`` (track, _last) gives where it is
    known. Only windows: no sequential state. Streams and pairs are sorted by
    different tasks, so that none holds both.
    """
    w = Window.partitionBy(*stream).orderBy(order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    s = raw.withColumns({"_s": F.sum("d").over(upto), "_on": F.count_if(F.col("d") == 1).over(upto)})
    m = s.withColumn("_m", F.least(F.lit(0), F.coalesce(F.min("_s").over(before), F.lit(0))))
    # The k-th on meets the k-th off that is not dropped; the fall of _m counts those that are.
    k = F.when(F.col("d") == 1, F.col("_on")).when((F.col("d") == -1) & (F.col("_s") >= F.col("_m")), F.col("_on") - F.col("_s") + F.col("_m"))
    pair = Window.partitionBy(*stream, "_k").orderBy(F.desc("d"))
    partner = lambda c: F.when(F.expr(" AND ".join(f"`{x}` IS NOT NULL" for x in stream)), F.lead(c).over(pair))
    met = m.withColumn("_k", k).where("_k IS NOT NULL").repartition(*stream, "_k").withColumns({"_end": partner("tick"), "end_seq": partner(order)}).where("d = 1")
    last = raw.groupBy(*track).agg(F.max("tick").alias("_last")) if ends is None else ends
    return met.join(last, track).withColumn("end_tick", F.coalesce("_end", "_last")).withColumn("duration_ticks", F.col("end_tick") - F.col("tick")).drop("_s", "_on", "_m", "_k", "_end", "_last", "d")


def phased_events(notes: DataFrame, meta: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, tick, phase, kind, ...): what a file holds in writing order: meta,
    programs, ends of sounding notes, starts, ends of notes of no length."""
    none = lambda t: F.lit(None).cast(t)
    end = F.col("tick") + F.greatest("duration_ticks", F.lit(0))
    event = lambda kind, tick, phase: F.struct(tick.alias("tick"), phase.alias("phase"), F.lit(kind).alias("kind"))
    # Both events of a note come from one reading of it.
    pair = F.array(event("note_on", F.col("tick"), F.lit(3)), event("note_off", end, F.when(F.col("duration_ticks") <= 0, 4).otherwise(2)))
    sounding = notes.select(key, F.explode(pair).alias("e"), "channel", "pitch", "velocity").select(key, "e.*", "channel", "pitch", "velocity", none("int").alias("tempo"), none("int").alias("numerator"), none("int").alias("denominator"))
    head = meta.select(key, "tick", F.lit(0).alias("phase"), "kind", none("int").alias("channel"), none("int").alias("pitch"), none("int").alias("velocity"), "tempo", "numerator", "denominator")
    return head.unionByName(sounding)


WRITE_ORDER = ("tick", "phase", "kind", "channel", "pitch", "velocity")


def delta_ticks(events: DataFrame, key: str = "piece_id") -> DataFrame:
    """Adds seq and delta: ticks since the event before, in writing order."""
    w = Window.partitionBy(key).orderBy(*WRITE_ORDER)
    return events.withColumn("seq", F.row_number().over(w)).withColumn("delta", F.col("tick") - F.coalesce(F.lag("tick").over(w), F.lit(0)))


def unmatched_offs(raw: DataFrame, stream: list[str], by: list[str], order: str = "seq") -> DataFrame:
    """(by, unmatched): note-offs that come before any note-on."""
    w = Window.partitionBy(*stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    low = raw.withColumn("_s", F.sum("d").over(w)).groupBy(*stream).agg(F.least(F.min("_s"), F.lit(0)).alias("_m"))
    return low.groupBy(*by).agg((-F.sum("_m")).alias("unmatched"))


def kept_performance(events: DataFrame, policy: str) -> DataFrame:
    """Controller, bend and pressure events under ``preserve`` (all) or
    ``score-only`` (none); ``strict`` refuses any."""
    extra = events.where(F.col("kind").isin("control_change", "pitch_bend", "aftertouch", "polytouch"))
    if policy == "preserve":
        return extra
    if policy == "score-only":
        return extra.where("false")
    if policy == "strict":
        return extra.where(F.assert_true(F.lit(False), F.lit("performance events are not allowed")).isNull())
    raise ValueError(f"no policy {policy!r}")


def performance_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n"))
