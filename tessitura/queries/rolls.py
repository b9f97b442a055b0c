"""Queries on pianorolls, segments and cell losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, meter, pianoroll
from ..plans.score import TICKS_PER_BEAT as TPB
from .meter import BARS
from .registry import query

STEP, STEPS = 120, 2560
CELLS = """SELECT DISTINCT piece_id, pitch, unnest(range(greatest(s, 0), least(e, 2560))) AS step FROM
    (SELECT piece_id, pitch, CAST(round_even(tick / 120, 0) AS BIGINT) AS s, greatest(CAST(round_even((tick + duration_ticks) / 120, 0) AS BIGINT), CAST(round_even(tick / 120, 0) AS BIGINT) + 1) AS e FROM note WHERE pitch BETWEEN 24 AND 107)"""
RUNS = f"""SELECT piece_id, pitch, min(step) AS start, max(step) + 1 AS "end" FROM (SELECT *, step - row_number() OVER (PARTITION BY piece_id, pitch ORDER BY step) AS i FROM ({CELLS}) c) r GROUP BY piece_id, pitch, i"""


def _cells(s):
    return pianoroll.cells(s.note, STEP, STEPS)


@query(CELLS)
def pianoroll_cells(s):
    return _cells(s)


@query(RUNS)
def pianoroll_runs(s):
    return pianoroll.runs(_cells(s))


@query(
    f"""WITH t AS (SELECT piece_id, pitch, CAST(round_even(tick / 120, 0) AS BIGINT) AS at, min((velocity, channel)) AS v FROM note GROUP BY ALL), r AS ({RUNS})
    SELECT r.piece_id, r.pitch, r.start, r."end", arg_min(t.v[1], (abs(t.at - r.start), t.at)) AS velocity, arg_min(t.v[2], (abs(t.at - r.start), t.at)) AS channel FROM r JOIN t ON r.piece_id = t.piece_id AND r.pitch = t.pitch GROUP BY ALL"""
)
def nearest_voice(s):
    template = s.note.select("piece_id", "pitch", F.bround(F.col("tick") / STEP, 0).cast("long").alias("start"), "velocity", "channel")
    return pianoroll.nearest_voices(pianoroll.runs(_cells(s)), template)


@query("SELECT v.piece_id, velocity, channel FROM (SELECT piece_id, CAST(least(greatest(round_even(quantile_cont(velocity, 0.5), 0), 1), 127) AS INTEGER) AS velocity FROM note GROUP BY piece_id) v JOIN (SELECT piece_id, arg_min(channel, (-n, channel)) AS channel FROM (SELECT piece_id, channel, count(*) AS n FROM note GROUP BY ALL) GROUP BY piece_id) c ON v.piece_id = c.piece_id")
def template_defaults(s):
    return pianoroll.template_defaults(s.note)


@query(
    f"""WITH {BARS} SELECT n.piece_id, unnest(generate_series(a.bar_index // 4, b.bar_index // 4)) AS segment, n.tick, n.pitch, n.duration_ticks
    FROM (SELECT *, greatest(tick, tick + duration_ticks - 1) AS last FROM note) n ASOF JOIN bars a ON n.piece_id = a.piece_id AND n.tick >= a.bar_start ASOF JOIN bars b ON n.piece_id = b.piece_id AND n.last >= b.bar_start"""
)
def segment_overlap(s):
    every = meter.bars(s.meter, intervals.end_ticks(s.note), TPB)
    return pianoroll.note_segments(s.note, every).select("piece_id", F.col("segment").cast("long").alias("segment"), "tick", "pitch", "duration_ticks")


ONSETS = "SELECT DISTINCT piece_id, pitch, CAST(round_even(tick / 120, 0) AS BIGINT) AS step FROM note WHERE pitch BETWEEN 24 AND 107 AND velocity > 20 AND round_even(tick / 120, 0) < 2560"


@query(
    f"""WITH e AS (SELECT piece_id, pitch, step, max(o) AS o FROM (SELECT piece_id, pitch, step, 0 AS o FROM ({CELLS}) c UNION ALL SELECT piece_id, pitch, step, 1 FROM ({ONSETS}) x) GROUP BY ALL),
    i AS (SELECT *, step - row_number() OVER (PARTITION BY piece_id, pitch ORDER BY step) AS i FROM e)
    SELECT piece_id, pitch, step FROM (SELECT *, max(o) OVER (PARTITION BY piece_id, pitch, i ORDER BY step ROWS UNBOUNDED PRECEDING) AS seen FROM i) WHERE seen = 1"""
)
def frame_cleanup(s):
    step = F.bround(F.col("tick") / STEP, 0).cast("long")
    onsets = s.note.where(F.col("pitch").between(24, 107) & (F.col("velocity") > 20)).select("piece_id", "pitch", step.alias("step")).where(F.col("step") < STEPS).distinct()
    return pianoroll.frame_cleanup(_cells(s), onsets)


@query(
    f"""WITH {BARS} SELECT piece_id, tick, pitch, CAST(k AS INTEGER) AS onset_step, abs(tick - bar_start - CAST(round_even((bar_end - bar_start) * k / 16, 0) AS BIGINT)) AS onset_error FROM
    (SELECT *, list_min([[abs(tick - bar_start - CAST(round_even((bar_end - bar_start) * k / 16, 0) AS BIGINT)), k] FOR k IN range(17)])[2] AS k FROM note n ASOF JOIN bars b ON n.piece_id = b.piece_id AND n.tick >= b.bar_start) z"""
)
def quantisation_errors(s):
    every = meter.bars(s.meter, intervals.end_ticks(s.note), TPB)
    return pianoroll.quantisation_errors(s.note, every).select("piece_id", "tick", "pitch", F.col("onset_step").cast("int").alias("onset_step"), "onset_error")


@query(
    """WITH p AS (SELECT group_id, velocity > 64 AS a, pitch > 60 AS b FROM note JOIN piece USING (piece_id))
    SELECT group_id, 2 * count_if(a AND b) / (count_if(a) + count_if(b)) AS f1 FROM p GROUP BY group_id""",
    rounds="f1",
)
def binary_f1(s):
    p = s.note.join(s.piece, "piece_id")
    return p.groupBy("group_id").agg(pianoroll.binary_f1(F.col("velocity") > 64, F.col("pitch") > 60).alias("f1"))


@query(
    """WITH g AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS threshold), p AS (SELECT velocity / 128 AS probability, pitch > 60 AS actual FROM note),
    f AS (SELECT threshold, 2 * count_if(probability >= threshold AND actual) / (count_if(probability >= threshold) + count_if(actual)) AS f1 FROM p, g GROUP BY threshold)
    SELECT threshold, f1, row_number() OVER (ORDER BY round(f1, 12) DESC, round(abs(threshold - 0.5), 12), threshold) = 1 AS chosen FROM f""",
    rounds="f1",
)
def threshold_grid(s):
    scored = s.note.select((F.col("velocity") / 128).alias("probability"), (F.col("pitch") > 60).alias("actual"))
    return pianoroll.threshold_grid(scored, [0.1, 0.3, 0.5, 0.7, 0.9])


@query("SELECT channel, least(greatest(CAST(sum(960 - duration_ticks) AS DOUBLE) / sum(duration_ticks), 1.0), 2.5) AS weight FROM note GROUP BY channel", rounds="weight")
def positive_weights(s):
    return pianoroll.positive_weights(s.note.withColumn("total", F.lit(960)), "duration_ticks", "total", 2.5, ["channel"])


@query("SELECT channel, sum(abs(velocity / 128 - pitch / 128) * (1 + channel) * CAST(duration_ticks > 0 AS INTEGER)) / greatest(sum((1 + channel) * CAST(duration_ticks > 0 AS INTEGER)), 1) AS loss FROM note GROUP BY channel", rounds="loss")
def masked_l1(s):
    cells = s.note.select("channel", (F.col("velocity") / 128).alias("predicted"), (F.col("pitch") / 128).alias("actual"), (1.0 + F.col("channel")).alias("weight"), (F.col("duration_ticks") > 0).cast("double").alias("mask"))
    return pianoroll.masked_l1(cells, ["channel"])
