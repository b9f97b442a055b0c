"""Queries on melody, intervals of ticks and polyphony."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, melody
from .registry import query

UNION = """
    WITH i AS (SELECT piece_id, tick AS s, tick + duration_ticks AS e FROM note WHERE duration_ticks > 0),
    m AS (SELECT *, max(e) OVER (PARTITION BY piece_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM i),
    g AS (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY piece_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
    u AS (SELECT piece_id, k, min(s) AS s, max(e) AS e FROM g GROUP BY piece_id, k)
"""


@query(f"{UNION} SELECT piece_id, CAST(k AS BIGINT) AS island, s AS start, e AS \"end\" FROM u")
def interval_union(s):
    spans = s.note.where("duration_ticks > 0").select("piece_id", F.col("tick").alias("start"), (F.col("tick") + F.col("duration_ticks")).alias("end"))
    return intervals.interval_union(spans, "piece_id")


REST = f"""{UNION}, a AS (SELECT piece_id, sum(e - s) AS active, count(*) AS islands FROM u GROUP BY piece_id)
    SELECT ends.piece_id, CAST(coalesce(active, 0) AS BIGINT) AS active, coalesce(islands, 0) AS islands, end_tick,
           CASE WHEN end_tick <= 0 THEN 0.0 ELSE least(greatest(1 - coalesce(active, 0) / end_tick, 0.0), 1.0) END AS rest_ratio
    FROM ends LEFT JOIN a USING (piece_id)"""


@query(f"SELECT composer, count(*) AS pieces, avg(rest_ratio) AS rest_ratio FROM ({REST}) r JOIN piece USING (piece_id) GROUP BY composer", rounds="rest_ratio")
def rest_ratio(s):
    return intervals.rest_ratio(s.note).join(s.piece, "piece_id").groupBy("composer").agg(F.count("*").alias("pieces"), F.avg("rest_ratio").alias("rest_ratio"))


SWEEP = """
    WITH b AS (SELECT piece_id, tick AS t, 1 AS c FROM {n} WHERE duration_ticks > 0 UNION ALL SELECT piece_id, tick + duration_ticks, -1 FROM {n} WHERE duration_ticks > 0),
    w AS (SELECT piece_id, t, sum(c) OVER (PARTITION BY piece_id ORDER BY t, c ROWS UNBOUNDED PRECEDING) AS a, lead(t) OVER (PARTITION BY piece_id ORDER BY t, c) AS n FROM b)
    SELECT piece_id, CAST(max(a) AS BIGINT) AS max_polyphony, CAST(sum(a * (n - t)) AS BIGINT) AS area, max(t) - min(t) AS span, sum(a * (n - t)) / (max(t) - min(t)) AS mean_polyphony FROM w GROUP BY piece_id
"""


@query(SWEEP.format(n="note"), rounds="mean_polyphony")
def polyphony_sweep(s):
    return intervals.polyphony(s.note)


@query(SWEEP.format(n="note").replace("WHERE duration_ticks > 0", ""), rounds="mean_polyphony")
def polyphony_with_zero_length(s):
    return intervals.polyphony(s.note, with_zero_length=True)


@query("SELECT * FROM skyline")
def skyline(s):
    return melody.skyline(s.note)


@query(
    """SELECT piece_id, CAST(avg(d) AS DOUBLE) AS mean_step, stddev_pop(d) AS std_step, avg(abs(d)) AS mean_size, CAST(count_if(d = 0) AS BIGINT) AS repeats, count(*) AS steps
    FROM (SELECT piece_id, pitch - lag(pitch) OVER (PARTITION BY piece_id ORDER BY tick) AS d FROM skyline) WHERE d IS NOT NULL GROUP BY piece_id""",
    rounds="mean_step std_step mean_size",
)
def melodic_stats(s):
    steps = melody.successive(melody.skyline(s.note), F.col("pitch"), "d").where("d IS NOT NULL")
    return steps.groupBy("piece_id").agg(
        F.avg("d").alias("mean_step"), F.stddev_pop("d").alias("std_step"), F.avg(F.abs("d")).alias("mean_size"), F.count_if(F.col("d") == 0).alias("repeats"), F.count("*").alias("steps")
    )


FLAGS = """SELECT *, row_number() OVER (PARTITION BY piece_id, tick, channel, pitch, velocity, duration_ticks) - 1 AS ordinal FROM note"""


@query(
    """SELECT piece_id, tick, channel, pitch, velocity, duration_ticks, CAST(row_number() OVER (PARTITION BY piece_id, tick, channel, pitch, velocity, duration_ticks) - 1 AS INTEGER) AS ordinal FROM note"""
)
def duplicate_ordinal(s):
    return melody.duplicate_ordinals(s.note).withColumn("ordinal", F.col("ordinal").cast("int"))


@query(
    f"""SELECT piece_id, tick, channel, pitch, velocity, duration_ticks, row_number() OVER (PARTITION BY piece_id, tick ORDER BY pitch DESC, channel, velocity, duration_ticks, ordinal) = 1 AS is_melody,
    sum(CASE WHEN pitch = top THEN 1 ELSE 0 END) OVER (PARTITION BY piece_id, tick) > 1 AS ambiguous
    FROM (SELECT *, max(pitch) OVER (PARTITION BY piece_id, tick) AS top FROM ({FLAGS}) f) t"""
)
def melody_flags(s):
    return melody.melody_flags(s.note).drop("ordinal")


SIGNS = """c AS (SELECT piece_id, tick, CAST(sign(pitch - lag(pitch) OVER (PARTITION BY piece_id ORDER BY tick)) AS INTEGER) AS x FROM skyline)"""


@query(
    f"""WITH {SIGNS}, g AS (SELECT piece_id, x AS g0, lead(x) OVER (PARTITION BY piece_id ORDER BY tick) AS g1 FROM c WHERE x IS NOT NULL)
    SELECT piece_id, g0, g1, count(*) AS n FROM g WHERE g1 IS NOT NULL GROUP BY ALL"""
)
def contour_bigrams(s):
    return melody.ngrams(melody.contour(s.note), "sign", 2).groupBy("piece_id", "g0", "g1").agg(F.count("*").alias("n"))


@query(
    f"""WITH {SIGNS}, g AS (SELECT piece_id, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c FROM c WHERE x IS NOT NULL WINDOW w AS (PARTITION BY piece_id ORDER BY tick))
    SELECT piece_id, count(DISTINCT (a, b, c)) / count(*) AS vocabulary_ratio, 1 - count(DISTINCT (a, b, c)) / count(*) AS repeat_ratio FROM g WHERE c IS NOT NULL GROUP BY piece_id""",
    rounds="vocabulary_ratio repeat_ratio",
)
def ngram_repeat(s):
    return melody.ngram_stats(melody.ngrams(melody.contour(s.note), "sign", 3))


@query(
    """WITH l AS (SELECT piece_id, pitch % 12 AS x, tick FROM skyline),
    d AS (SELECT piece_id, """
    + ", ".join(f"avg(CAST(x = l{k} AS INTEGER)) AS m{k}" for k in range(1, 9))
    + " FROM (SELECT *, "
    + ", ".join(f"lag(x, {k}) OVER (PARTITION BY piece_id ORDER BY tick) AS l{k}" for k in range(1, 9))
    + " FROM l) z GROUP BY piece_id) SELECT piece_id, coalesce(greatest("
    + ", ".join(f"m{k}" for k in range(1, 9))
    + "), 0.0) AS best_lag_similarity FROM d",
    rounds="best_lag_similarity",
)
def best_lag(s):
    return melody.best_lag(melody.skyline(s.note).withColumn("x", F.pmod("pitch", F.lit(12))), "x")


@query(
    """SELECT conv_id, CAST(avg(d) AS DOUBLE) AS mean_step, count(*) AS steps FROM
    (SELECT conv_id, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS d FROM conversations) WHERE d IS NOT NULL GROUP BY conv_id""",
    rounds="mean_step",
)
def turn_length_steps(s):
    turns = s.table("conversations").withColumn("n", F.length("text"))
    return melody.successive(turns, F.col("n"), "d", "conv_id", "turn").where("d IS NOT NULL").groupBy("conv_id").agg(F.avg("d").alias("mean_step"), F.count("*").alias("steps"))
