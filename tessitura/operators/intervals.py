"""Intervals of ticks: ends, unions, sweep lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio


def end_ticks(notes: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, end_tick): the last tick at which a note sounds."""
    return notes.groupBy(key).agg(F.coalesce(F.max(F.col("tick") + F.col("duration_ticks")), F.lit(0)).alias("end_tick"))


def interval_union(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, island, start, end): overlapping or touching spans merged."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    marked = spans.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end))


def rest_ratio(notes: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, active, islands, end_tick, rest_ratio): silence from tick 0 on."""
    sounding = notes.where("duration_ticks > 0").select(key, F.col("tick").alias("start"), (F.col("tick") + F.col("duration_ticks")).alias("end"))
    active = interval_union(sounding, key).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("active"), F.count("*").alias("islands"))
    ends = notes.groupBy(key).agg(F.max(F.col("tick") + F.greatest("duration_ticks", F.lit(0))).alias("end_tick"))
    share = F.least(F.greatest(1 - F.col("active") / F.col("end_tick"), F.lit(0.0)), F.lit(1.0))
    return (
        ends.join(active, key, "left")
        .na.fill(0, ["active", "islands"])
        .withColumn("rest_ratio", F.when(F.col("end_tick") <= 0, F.lit(0.0)).otherwise(share))
    )


def sweep_line(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, t, change, active, until): running number of open spans; at one
    tick spans close before others open."""
    edges = spans.select(key, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("change")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("change")))).alias("e")).select(key, "e.*")
    order = Window.partitionBy(key).orderBy("t", "change")
    return edges.withColumn("active", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("t").over(order))


def polyphony(notes: DataFrame, key: str = "piece_id", zero_span: str = "zero", with_zero_length: bool = False) -> DataFrame:
    """(key, max_polyphony, area, span, mean_polyphony). ``zero_span`` tells the
    mean where nothing spans time: ``zero`` or ``max``."""
    sounding = notes if with_zero_length else notes.where("duration_ticks > 0")
    spans = sounding.select(key, F.col("tick").alias("start"), (F.col("tick") + F.col("duration_ticks")).alias("end"))
    swept = sweep_line(spans, key).groupBy(key).agg(
        F.greatest(F.max("active"), F.lit(0)).alias("max_polyphony"),
        F.coalesce(F.sum(F.col("active") * (F.col("until") - F.col("t"))), F.lit(0)).alias("area"),
        (F.max("t") - F.min("t")).alias("span"),
    )
    still = F.lit(0.0) if zero_span == "zero" else F.col("max_polyphony").cast("double")
    mean = F.when(F.col("span") == 0, still).otherwise(F.try_divide(F.col("area").cast("double"), F.col("span")))
    return swept.withColumn("mean_polyphony", mean)


def zero_duration_share(notes: DataFrame, key: str = "piece_id") -> DataFrame:
    return notes.groupBy(key).agg(ratio(F.count_if(F.col("duration_ticks") <= 0), F.count("*")).alias("zero_duration_ratio"))
