"""Scans, projections and transformations of notes; raw events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import clamp, hash_uniform
from ..operators import contracts, events, intervals, transform
from .registry import query


@query("SELECT * FROM note")
def note_scan(s):
    return s.note


@query("SELECT piece_id, tick, pitch FROM note WHERE pitch BETWEEN 48 AND 71 AND duration_ticks > 240")
def pitch_range_filter(s):
    return s.note.where("pitch BETWEEN 48 AND 71 AND duration_ticks > 240").select("piece_id", "tick", "pitch")


@query("SELECT piece_id, tick, pitch, CAST(least(greatest(velocity * 2 - 60, 1), 127) AS INTEGER) AS velocity FROM note")
def velocity_clamp(s):
    return s.note.select("piece_id", "tick", "pitch", clamp(F.col("velocity") * 2 - 60, 1, 127).cast("int").alias("velocity"))


@query("SELECT * FROM output_note")
def genome_transform(s):
    return s.output


@query(
    """WITH g(genome_id, transpose, density, duration, velocity) AS (VALUES (0, 0, 1.0, 1.0, 0), (1, 40, 0.5, 1.5, 10), (2, -30, 1.25, 0.5, -20))
    SELECT genome_id, piece_id, count(*) AS n, CAST(sum(greatest(CAST(round_even(tick * g.density::DOUBLE, 0) AS BIGINT), 0)) AS BIGINT) AS ticks,
           CAST(sum(greatest(CAST(round_even(duration_ticks * g.duration::DOUBLE, 0) AS BIGINT), 0)) AS BIGINT) AS lengths,
           CAST(sum(pitch + transpose) AS BIGINT) AS pitches, CAST(sum(least(greatest(note.velocity + g.velocity, 0), 127)) AS BIGINT) AS velocities
    FROM note, g WHERE pitch + transpose BETWEEN 0 AND 127 GROUP BY ALL"""
)
def genome_sweep(s):
    genomes = s.spark.createDataFrame(
        [(0, 0.0, 1.0, 1.0, 0.0), (1, 40.0, 0.5, 1.5, 10.0), (2, -30.0, 1.25, 0.5, -20.0)], "genome_id int, transpose double, density double, duration double, velocity double"
    )
    swept = transform.genome_sweep(s.note, genomes)
    return swept.groupBy("genome_id", "piece_id").agg(
        F.count("*").alias("n"), F.sum("tick").alias("ticks"), F.sum("duration_ticks").alias("lengths"), F.sum("pitch").alias("pitches"), F.sum("velocity").alias("velocities")
    )


@query(
    """SELECT piece_id, count(*) AS n_notes, CAST(count_if(NOT (tick >= 0 AND pitch BETWEEN 0 AND 127 AND velocity BETWEEN 1 AND 126 AND duration_ticks >= 0)) AS BIGINT) AS n_invalid,
    CASE WHEN n_invalid > 0 THEN 'invalid notes' END AS exclusion_reason, CASE WHEN n_invalid > 0 THEN 'excluded' ELSE 'accepted' END AS validation_status
    FROM note GROUP BY piece_id"""
)
def accepted_filter(s):
    strange = s.note.withColumn("velocity", F.when(F.col("velocity") == 127, 0).otherwise(F.col("velocity")))
    return contracts.problems_with_notes(strange)


@query("SELECT piece_id, max(tick + duration_ticks) AS end_tick FROM note GROUP BY piece_id")
def end_ticks(s):
    return intervals.end_ticks(s.note)


@query(
    """SELECT piece_id, tick, CAST(('0x' || substr(sha256('7|draw|' || piece_id || '|' || tick), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0 AS u
    FROM (SELECT DISTINCT piece_id, tick FROM note)""",
    rounds="u",
)
def hash_uniforms(s):
    return s.note.select("piece_id", "tick").distinct().withColumn("u", hash_uniform(F.lit(7), F.lit("draw"), F.col("piece_id"), F.col("tick")))


_PHASED = """
    SELECT piece_id, tick, 0 AS phase, 'tempo' AS kind, NULL::INTEGER AS channel, NULL::INTEGER AS pitch, NULL::INTEGER AS velocity FROM tempo
    UNION ALL SELECT piece_id, tick, 0, 'time_signature', NULL, NULL, NULL FROM meter
    UNION ALL SELECT piece_id, tick, 3, 'note_on', channel, pitch, velocity FROM note
    UNION ALL SELECT piece_id, tick + duration_ticks, CASE WHEN duration_ticks <= 0 THEN 4 ELSE 2 END, 'note_off', channel, pitch, velocity FROM note
"""


@query(f"SELECT * FROM ({_PHASED}) x")
def event_phase_sort(s):
    return events.phased_events(s.note, s.meta).select("piece_id", "tick", "phase", "kind", "channel", "pitch", "velocity")


@query(
    f"""SELECT piece_id, tick, phase, kind, tick - coalesce(lag(tick) OVER w, 0) AS delta, row_number() OVER w AS seq FROM ({_PHASED}) x
    WINDOW w AS (PARTITION BY piece_id ORDER BY tick, phase, kind, channel NULLS FIRST, pitch NULLS FIRST, velocity NULLS FIRST)"""
)
def delta_ticks(s):
    return events.delta_ticks(events.phased_events(s.note, s.meta)).select("piece_id", "tick", "phase", "kind", "delta", F.col("seq").cast("long").alias("seq"))


def _raw(s):
    return s.table("events").select(
        F.col("user_id").alias("f"), F.col("event_id").alias("seq"), F.col("event_id").alias("tick"), F.when(F.col("event_type") == "click", -1).otherwise(1).alias("d")
    )


@query(
    """WITH raw AS (SELECT user_id AS f, event_id AS seq, CASE WHEN event_type = 'click' THEN -1 ELSE 1 END AS d FROM events),
    s AS (SELECT *, sum(d) OVER (PARTITION BY f ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM raw),
    m AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY f ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS m FROM s),
    o AS (SELECT f, seq, row_number() OVER (PARTITION BY f ORDER BY seq) AS k FROM m WHERE d = 1),
    z AS (SELECT f, seq, row_number() OVER (PARTITION BY f ORDER BY seq) AS k FROM m WHERE d = -1 AND NOT s < m),
    l AS (SELECT f, max(seq) AS mx FROM raw GROUP BY f)
    SELECT o.f, o.seq AS start_seq, coalesce(z.seq, l.mx) AS end_seq FROM o JOIN l ON o.f = l.f LEFT JOIN z ON o.f = z.f AND o.k = z.k"""
)
def fifo_pairing(s):
    return events.pair_notes(_raw(s), ["f"], ["f"]).select("f", F.col("seq").alias("start_seq"), F.col("end_tick").alias("end_seq"))


@query(
    """WITH raw AS (SELECT user_id AS f, event_id AS seq, CASE WHEN event_type = 'click' THEN -1 ELSE 1 END AS d FROM events),
    s AS (SELECT f, sum(d) OVER (PARTITION BY f ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM raw)
    SELECT f, CAST(-least(min(s), 0) AS BIGINT) AS unmatched FROM s GROUP BY f"""
)
def unmatched_note_offs(s):
    return events.unmatched_offs(_raw(s), ["f"], ["f"])


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def performance_counts(s):
    return events.performance_counts(s.table("events").withColumnRenamed("event_type", "kind"))
