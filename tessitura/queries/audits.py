"""Queries on audits, gates, reports and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import clip_seconds, tempo_microseconds
from ..operators import audit, intervals, meter, normality, pianoroll
from ..plans.score import TICKS_PER_BEAT as TPB
from .meter import BARS
from .registry import query


@query(
    f"""WITH {BARS}, e AS (SELECT n.piece_id, n.duration_ticks, list_min([abs(tick - bar_start - CAST(round_even((bar_end - bar_start) * k / 16, 0) AS BIGINT)) FOR k IN range(17)]) AS err FROM note n ASOF JOIN bars b ON n.piece_id = b.piece_id AND n.tick >= b.bar_start)
    SELECT fold, composer, count(*) AS notes, CAST(count_if(duration_ticks <= 0) AS BIGINT) AS zero_length, avg(err) AS mean_error, list_sort(list(err))[CAST(floor(0.95::DOUBLE * (count(*) - 1)) AS BIGINT) + 1] AS p95_error FROM e JOIN piece USING (piece_id) GROUP BY fold, composer""",
    rounds="mean_error",
)
def quantisation_audit(s):
    every = meter.bars(s.meter, intervals.end_ticks(s.note), TPB)
    placed = pianoroll.quantisation_errors(s.note, every).join(s.piece.select("piece_id", "fold", "composer"), "piece_id")
    return audit.audit_counts(placed, ["fold", "composer"], "onset_error")


@query("SELECT numerator, denominator, count(*) AS n FROM meter GROUP BY ALL")
def meter_counts(s):
    return audit.meter_counts(s.meter)


RECORDS = """SELECT p.composer AS source, l.composer AS target, ((p.piece_id * 13 + length(l.composer) * 7) % 41 - 18) / 100.0::DOUBLE AS delta, p.piece_id % 9 = 0 AS fallback, p.piece_id % 50 <> 49 AS valid
    FROM piece p JOIN (SELECT DISTINCT composer FROM piece) l ON l.composer <> p.composer"""


def _records(s):
    labels = s.piece.select(F.col("composer").alias("target")).distinct()
    pairs = s.piece.withColumnRenamed("composer", "source").join(F.broadcast(labels), F.col("source") != F.col("target"))  # a few labels
    delta = (F.pmod(F.col("piece_id") * 13 + F.length("target") * 7, F.lit(41)) - 18) / 100.0
    return pairs.select("source", "target", delta.alias("delta"), (F.pmod("piece_id", F.lit(9)) == 0).alias("fallback"), (F.pmod("piece_id", F.lit(50)) != 49).alias("valid"))


@query(
    f"""SELECT source || '→' || target AS direction, count(*) AS n, avg(delta) AS mean_delta, quantile_cont(delta, 0.5) AS median_delta, CAST(count_if(delta > 0) AS BIGINT) AS positive, avg(CAST(fallback AS INTEGER)) AS fallback_rate, bool_and(valid) AS all_valid
    FROM ({RECORDS}) r GROUP BY 1""",
    rounds="mean_delta median_delta fallback_rate",
)
def direction_summary(s):
    return audit.record_summary(_records(s).withColumn("direction", audit.direction(F.col("source"), F.col("target"))), ["direction"])


@query(f"SELECT 'enough' AS criterion, count(*) >= 20 AS passed FROM ({RECORDS}) r UNION ALL SELECT 'gain', avg(delta) > 0 FROM ({RECORDS}) r UNION ALL SELECT 'valid', bool_and(valid) FROM ({RECORDS}) r")
def closure_gates(s):
    from ..sources.tables import gate

    return gate(_records(s), {"enough": "count(*) >= 20", "gain": "avg(delta) > 0", "valid": "bool_and(valid)"})


@query(f"WITH {BARS} SELECT piece_id, greatest(1, max(CAST(round_even((bar_end - bar_start) / 16, 0) AS BIGINT))) AS allowed_ticks FROM bars GROUP BY piece_id")
def allowed_length_error(s):
    return audit.allowed_length_error(meter.bars(s.meter, intervals.end_ticks(s.note), TPB))


@query(
    """WITH a AS (SELECT piece_id, count(*) AS na FROM note GROUP BY piece_id), c AS (SELECT piece_id, tick, count(*) AS size, min(pitch) AS low, max(pitch) AS high FROM output_note GROUP BY ALL), b AS (SELECT piece_id, sum(size) AS nb, max(size) AS voices, min(low) AS low, max(high) AS high FROM c GROUP BY piece_id)
    SELECT piece_id, nb / na AS note_ratio, nb / na BETWEEN 0.25 AND 4 AND voices <= 4 AND low >= 0 AND high <= 127 AS sane FROM a JOIN b USING (piece_id)""",
    rounds="note_ratio",
)
def sane_outputs(s):
    return audit.sane_outputs(s.note, s.output, 4)


@query("SELECT composer, count(*) AS n FROM piece GROUP BY composer HAVING count(*) < 20")
def too_few_files(s):
    return audit.too_few_files(s.piece, "composer", 20)


@query("SELECT avg(CAST(velocity = 1 AS INTEGER)) AS low_share, avg(CAST(velocity = 127 AS INTEGER)) AS high_share FROM note", rounds="low_share high_share")
def genes_at_bounds(s):
    return audit.at_bounds(s.note, "velocity", 1.0, 127.0)


@query(
    """SELECT series, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.5) AS median, min(v) AS min, max(v) AS max FROM (SELECT 'before' AS series, avg(pitch) AS v FROM note GROUP BY piece_id UNION ALL SELECT 'after', avg(pitch) FROM output_note GROUP BY piece_id) x GROUP BY series""",
    rounds="mean std median min max",
)
def objective_series(s):
    mean = lambda n, c: n.groupBy("piece_id").agg(F.avg("pitch").alias(c))
    stats, _ = audit.objective_report(mean(s.note, "before").join(mean(s.output, "after"), "piece_id"), ["before", "after"], "before", "after")
    return stats


@query()
def objective_tests(s):
    mean = lambda n, c: n.groupBy("piece_id").agg(F.avg("velocity").alias(c))
    _, tests = audit.objective_report(mean(s.note, "before").join(mean(s.output, "after"), "piece_id"), ["before", "after"], "before", "after")
    return tests


@query(
    """WITH e AS (SELECT label, [embedding[i]::DOUBLE FOR i IN range(1, 11)] AS x FROM embeddings)
    SELECT avg(ln(list_sum([exp(y - list_max(x)) FOR y IN x])) + list_max(x) - x[label + 1]) AS class_loss, avg((x[1] - 1) ** 2) AS real_loss, avg(x[2] ** 2) AS fake_loss, avg(abs(x[1] - x[2])) AS cycle_loss FROM e""",
    rounds="class_loss real_loss fake_loss cycle_loss",
)
def loss_terms(s):
    e = s.table("embeddings").select("label", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("x"))
    return e.agg(
        audit.cross_entropy(F.col("x"), F.col("label")).alias("class_loss"), audit.least_squares_adversarial(F.col("x")[0], True).alias("real_loss"),
        audit.least_squares_adversarial(F.col("x")[1], False).alias("fake_loss"), audit.mean_absolute(F.col("x")[0], F.col("x")[1]).alias("cycle_loss"),
    )


@query("SELECT event_id, least(greatest(value / 10, 0.0), 15.0) AS clip_s, CASE WHEN event_id % 3 = 0 THEN CAST(400000 + event_id AS BIGINT) WHEN event_id % 3 = 1 THEN CAST(round_even(60e6 / (60 + event_id % 100), 0) AS BIGINT) ELSE 500000 END AS tempo FROM events", rounds="clip_s")
def clip_and_tempo(s):
    kind = F.pmod("event_id", F.lit(3))
    tempo, bpm = F.when(kind == 0, 400000 + F.col("event_id")), F.when(kind == 1, (60 + F.pmod("event_id", F.lit(100))).cast("double"))
    return s.table("events").select("event_id", clip_seconds(F.col("value") / 10).cast("double").alias("clip_s"), tempo_microseconds(tempo, bpm).alias("tempo"))


@query()
def objective_choice(s):
    """Of every region the paired test that its pieces' differences ask for, before and after."""
    mean = lambda n, c: n.groupBy("piece_id").agg(F.avg("velocity").alias(c))
    pairs = mean(s.note, "before").join(mean(s.output, "after"), "piece_id").join(s.piece.select("piece_id", "composer"), "piece_id")
    return normality.chosen_tests(pairs, "before", "after", ["composer"]).withColumns({c: F.round(c, 9) for c in ("statistic", "p", "normality_p")})
