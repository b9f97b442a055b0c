"""Queries on meter and tempo."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, melody, meter
from ..plans.score import TICKS_PER_BEAT as TPB
from .registry import query

METERED = """SELECT n.*, m.numerator, m.denominator, m.tick AS segment_tick FROM {n} n ASOF JOIN meter m ON n.piece_id = m.piece_id AND n.tick >= m.tick"""
SEGMENTS = """segs AS (SELECT m.piece_id, m.tick AS s, least(coalesce(lead(m.tick) OVER (PARTITION BY m.piece_id ORDER BY m.tick), end_tick), end_tick) AS e, numerator, denominator,
    (4 * 480 * numerator) // denominator AS len FROM meter m JOIN ends USING (piece_id) WHERE m.tick <= end_tick)"""
BARS = f"""{SEGMENTS}, bars AS (SELECT piece_id, row_number() OVER (PARTITION BY piece_id ORDER BY b) - 1 AS bar_index, b AS bar_start, least(b + len, e) AS bar_end, numerator, denominator
    FROM (SELECT *, unnest(generate_series(s, e - 1, len)) AS b FROM segs WHERE e > s))"""


@query(METERED.format(n="note"))
def meter_asof(s):
    return meter.with_meter(s.note, s.meter)


@query(f"WITH {BARS} SELECT piece_id, bar_index, bar_start, bar_end, numerator, denominator FROM bars")
def bars(s):
    found = meter.bars(s.meter, intervals.end_ticks(s.note), TPB)
    return found.withColumn("bar_index", F.col("bar_index").cast("long"))


@query(f"WITH {BARS} SELECT n.*, b.bar_index, b.bar_start, b.bar_end FROM note n ASOF JOIN bars b ON n.piece_id = b.piece_id AND n.tick >= b.bar_start")
def note_to_bar(s):
    return meter.notes_in_bars(s.note, s.meter, TPB).withColumn("bar_index", F.col("bar_index").cast("long"))


@query(f"WITH {SEGMENTS} SELECT piece_id, sum((e - s) * denominator / (1920.0 * numerator)) AS length_bars FROM segs GROUP BY piece_id", rounds="length_bars")
def length_bars(s):
    return meter.length_in_bars(s.meter, intervals.end_ticks(s.note), TPB)


EMPTY = f"""WITH {BARS}, occ AS (SELECT DISTINCT b.piece_id, b.bar_index FROM note n JOIN bars b ON n.piece_id = b.piece_id AND n.tick < b.bar_end AND n.tick + n.duration_ticks > b.bar_start WHERE n.duration_ticks > 0)
    SELECT piece_id, count(*) AS bar_count, (count(*) - count(occ.bar_index)) / greatest(count(*), 1) AS empty_bar_ratio FROM bars LEFT JOIN occ USING (piece_id, bar_index) GROUP BY piece_id"""


@query(EMPTY, rounds="empty_bar_ratio")
def empty_bar_ratio(s):
    return meter.empty_bar_ratio(s.note, s.meter, TPB)


PLACED = """SELECT piece_id, numerator, denominator, duration_ticks, ((tick - segment_tick) * denominator) % (1920 * numerator) AS bp, ((tick - segment_tick) * denominator) % 1920 AS pp FROM ({m}) z"""


@query(
    f"""SELECT piece_id, avg(CAST(bp = 0 AS INTEGER)) AS downbeat, avg(CAST(pp = 0 AS INTEGER)) AS pulse, avg(CAST(pp * 2 = 1920 AS INTEGER)) AS offbeat
    FROM ({PLACED.format(m=METERED.format(n="(SELECT DISTINCT piece_id, tick, 0 AS duration_ticks FROM note)"))}) y GROUP BY piece_id""",
    rounds="downbeat pulse offbeat",
)
def metrical_ratios(s):
    placed = meter.positions(s.note.select("piece_id", "tick").distinct(), s.meter, TPB)
    share = lambda p: F.avg(p.cast("double"))
    return placed.groupBy("piece_id").agg(
        share(F.col("bar_position") == 0).alias("downbeat"), share(F.col("pulse_position") == 0).alias("pulse"), share(F.col("pulse_position") * 2 == F.col("pulse_length")).alias("offbeat")
    )


@query(
    f"SELECT piece_id, avg(CAST(pp > 0 AND duration_ticks * denominator > 1920 - pp AS INTEGER)) AS syncopated FROM ({PLACED.format(m=METERED.format(n='note'))}) y GROUP BY piece_id",
    rounds="syncopated",
)
def syncopation(s):
    held = F.col("duration_ticks") * F.col("denominator") > F.col("pulse_length") - F.col("pulse_position")
    return meter.positions(s.note, s.meter, TPB).groupBy("piece_id").agg(F.avg(((F.col("pulse_position") > 0) & held).cast("double")).alias("syncopated"))


@query("SELECT piece_id, avg(60e6 / tempo) AS tempo_bpm FROM tempo GROUP BY piece_id", rounds="tempo_bpm")
def tempo_mean(s):
    return meter.mean_tempo(s.piece, s.tempo)


@query("SELECT piece_id, end_tick * tempo / (480 * 1e6) AS duration_s FROM ends JOIN tempo USING (piece_id)", rounds="duration_s")
def duration_seconds_tempo_map(s):
    return meter.duration_seconds(intervals.end_ticks(s.note), s.tempo, TPB)


@query("SELECT piece_id, tick, numerator, denominator FROM meter WHERE numerator % 2 = 1 AND false")
def meter_problems(s):
    return meter.meter_problems(s.meter, TPB)


@query(
    """SELECT piece_id, avg(d / 480.0) AS ioi_mean, stddev_pop(d / 480.0) AS ioi_std FROM
    (SELECT piece_id, tick - lag(tick) OVER (PARTITION BY piece_id ORDER BY tick) AS d FROM skyline) WHERE d IS NOT NULL GROUP BY piece_id""",
    rounds="ioi_mean ioi_std",
)
def ioi_stats(s):
    gaps = melody.successive(s.note.select("piece_id", "tick").distinct(), F.col("tick"), "d").where("d IS NOT NULL").withColumn("ioi", F.col("d") / TPB)
    return gaps.groupBy("piece_id").agg(F.avg("ioi").alias("ioi_mean"), F.stddev_pop("ioi").alias("ioi_std"))
