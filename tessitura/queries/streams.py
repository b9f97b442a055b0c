"""Structured Streaming runs over the events table, drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.checkpoints import shared_dir
from ..streaming import notes, timers
from .registry import query


def _stream(s):
    # The table is a file or a folder; a stream reads a folder by a name filter.
    schema = s.table("events").schema
    raw = s.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    files = raw.parquet(s.sf_dir + "/events.parque[t]")
    return files.select(
        F.col("user_id").alias("piece_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        (36 + F.pmod(F.floor(F.col("value") * 100), F.lit(48))).cast("int").alias("pitch"), F.when(F.col("event_type") == "click", -1).otherwise(1).alias("d"),
    )


@query("SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, count(*) AS n, CAST(sum(pitch) AS BIGINT) AS pitches FROM ev GROUP BY 1")
def stream_tumbling(s):
    out = notes.drained(notes.tumbling(_stream(s), "1 hour"), shared_dir(s.spark), "complete")
    return out.withColumn("start", F.unix_seconds("start"))


@query("SELECT epoch(b)::BIGINT AS start, pitch, count(*) AS n FROM (SELECT pitch, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) + INTERVAL '30 minutes', time_bucket(INTERVAL '1 hour', ts) - INTERVAL '30 minutes']) AS b, ts FROM ev) z WHERE ts >= b AND ts < b + INTERVAL '1 hour' GROUP BY ALL")
def stream_sliding(s):
    out = notes.drained(notes.sliding(_stream(s), "1 hour", "30 minutes"), shared_dir(s.spark), "complete")
    return out.withColumn("start", F.unix_seconds("start"))


@query(
    """WITH g AS (SELECT piece_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY piece_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS b FROM ev),
    k AS (SELECT *, sum(b) OVER (PARTITION BY piece_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT piece_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL '6 hours') AS "end", count(*) AS n FROM k GROUP BY piece_id, k HAVING max(ts) + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM ev)"""
)
def stream_session(s):
    """Phrases that the watermark has closed; the open tail stays in the state."""
    out = notes.drained(notes.phrases(_stream(s), "6 hours"), shared_dir(s.spark))
    return out.withColumn("start", F.unix_micros("start")).withColumn("end", F.unix_micros("end"))


@query("SELECT event_id AS seq FROM events")
def stream_dedup(s):
    twice = _stream(s).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return notes.drained(notes.deduplicated(twice, ["seq"]), shared_dir(s.spark)).select("seq")


_PAIRING = """WITH raw AS (SELECT user_id AS piece_id, CAST(36 + CAST(floor(value * 100) AS BIGINT) % 48 AS INTEGER) AS pitch, event_id AS seq, CASE WHEN event_type = 'click' THEN -1 ELSE 1 END AS d FROM events),
    s AS (SELECT *, sum(d) OVER (PARTITION BY piece_id, pitch ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM raw),
    m AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY piece_id, pitch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS m FROM s),
    o AS (SELECT piece_id, pitch, seq, row_number() OVER (PARTITION BY piece_id, pitch ORDER BY seq) AS k FROM m WHERE d = 1),
    z AS (SELECT piece_id, pitch, seq, row_number() OVER (PARTITION BY piece_id, pitch ORDER BY seq) AS k FROM m WHERE d = -1 AND NOT s < m)"""


@query(f"{_PAIRING} SELECT piece_id, pitch, o.seq AS start_seq, z.seq AS end_seq FROM o JOIN z USING (piece_id, pitch, k)")
def stream_pairing(s):
    return notes.drained(notes.paired(_stream(s)), shared_dir(s.spark))


LONGEST_MS = 6 * 3600 * 1000


@query(
    f"""{_PAIRING} SELECT piece_id, pitch, o.seq AS start_seq, z.seq AS end_seq, CASE WHEN z.seq IS NULL THEN 'hanging' ELSE 'paired' END AS reason
    FROM o LEFT JOIN z USING (piece_id, pitch, k) JOIN events ON event_id = o.seq WHERE z.seq IS NOT NULL OR epoch_ms(events.ts) + {LONGEST_MS} <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)"""
)
def stream_pairing_timers(s):
    """As stream_pairing, and notes that nothing closed within six hours of event time."""
    with timers.rocks(s.spark):
        return notes.drained(timers.paired_or_closed(_stream(s), LONGEST_MS), shared_dir(s.spark))
