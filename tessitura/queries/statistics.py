"""Queries on resampling, tests and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resampling, tasks
from .models import CENTROID, predictions
from .registry import query


def _h(*parts: str) -> str:
    key = " || '|' || ".join(parts)
    return f"CAST(('0x' || substr(sha256({key}), 1, 16)) AS UBIGINT)"


GAIN = "SELECT group_id, composer, piece_id, (piece_id * 37 % 101) / 100.0 - 0.4 AS gain FROM piece"


def _gain(s):
    return s.piece.select("group_id", "composer", "piece_id", (F.pmod(F.col("piece_id") * 37, F.lit(101)) / 100.0 - 0.4).alias("gain"))


@query(
    f"""WITH g AS ({GAIN}), c AS (SELECT composer, group_id, sum(gain) AS s, count(*) AS n, row_number() OVER (PARTITION BY composer ORDER BY group_id) - 1 AS spot, count(*) OVER (PARTITION BY composer) AS k FROM g GROUP BY composer, group_id),
    d AS (SELECT c.composer, b AS draw, {_h("'9'", "b", "c.composer", "spot")} % k AS pick FROM c, (SELECT unnest(range(200)) AS b)),
    m AS (SELECT draw, sum(s) / sum(n) AS m FROM d JOIN c ON d.composer = c.composer AND d.pick = c.spot GROUP BY draw)
    SELECT (SELECT avg(gain) FROM g) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m""",
    rounds="mean low high",
)
def cluster_bootstrap_ci(s):
    return resampling.cluster_bootstrap(_gain(s), "gain", "composer", "group_id", 200, 9)


@query(
    f"""WITH p AS MATERIALIZED ({CENTROID}), g AS (SELECT group_id, true_label, predicted_label, count(*) AS n FROM p GROUP BY ALL), o AS (SELECT sum(CASE WHEN true_label = predicted_label THEN n ELSE 0 END) / sum(n) AS observed FROM g),
    e AS (SELECT DISTINCT group_id, true_label, b AS draw FROM g, (SELECT unnest(range(99)) AS b)),
    w AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY group_id) AS spot FROM e), z AS (SELECT draw, true_label AS dealt, row_number() OVER (PARTITION BY draw ORDER BY {_h("'4'", "draw", "group_id")}, group_id) AS spot FROM e),
    sc AS (SELECT draw, sum(CASE WHEN dealt = predicted_label THEN n ELSE 0 END) / sum(n) AS score FROM w JOIN z USING (draw, spot) JOIN g USING (group_id) GROUP BY draw)
    SELECT (SELECT observed FROM o) AS observed, (count_if(score >= (SELECT observed FROM o) - 1e-12) + 1) / 100.0::DOUBLE AS p FROM sc""",
    rounds="observed p",
)
def label_permutation_p(s):
    groups = predictions(s).groupBy("group_id", "true_label", "predicted_label").agg(F.count("*").alias("n"))
    return resampling.label_permutation_p(groups, 99, 4)


@query(
    f"""WITH m AS (SELECT group_id, avg(gain) AS m FROM ({GAIN}) g GROUP BY group_id), f AS (SELECT b, avg(m * CASE WHEN {_h("'6'", "b", "group_id")} % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x FROM m, (SELECT unnest(range(199)) AS b) GROUP BY b)
    SELECT (SELECT avg(m) FROM m) AS mean, (count_if(abs(x) >= abs((SELECT avg(m) FROM m)) - 1e-12) + 1) / 200.0::DOUBLE AS p FROM f""",
    rounds="mean p",
)
def sign_permutation_p(s):
    return resampling.sign_permutation_p(_gain(s), "gain", "group_id", 199, 6)


@query(
    """WITH p AS (SELECT group_id, (group_id * 7 % 25 + 1) / 250.0::DOUBLE AS p FROM (SELECT DISTINCT group_id FROM piece)),
    r AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, group_id) + 1) * p) AS raw FROM p)
    SELECT group_id, p, max(raw) OVER (ORDER BY p, group_id ROWS UNBOUNDED PRECEDING) AS p_adjusted FROM r""",
    rounds="p p_adjusted",
)
def holm_adjust(s):
    tests = s.piece.select("group_id").distinct().withColumn("p", (F.pmod(F.col("group_id") * 7, F.lit(25)) + 1) / 250.0)
    return resampling.holm(tests, "p", "group_id")


@query(
    """SELECT event_type, count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.5) AS median, min(x) AS min, max(x) AS max
    FROM (SELECT event_type, CASE WHEN event_id % 10 <> 0 THEN value END AS x FROM events) e GROUP BY event_type""",
    rounds="mean std median min max",
)
def finite_stats(s):
    holes = F.when(F.pmod("event_id", F.lit(10)) == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return resampling.finite_stats(s.table("events").withColumn("x", holes), "x", ["event_type"])


@query(
    """SELECT composer, count(*) AS n, corr(a, b) AS r FROM (SELECT piece_id, CAST(avg(pitch) AS DOUBLE) AS a, CAST(avg(duration_ticks) AS DOUBLE) AS b FROM note GROUP BY piece_id) x JOIN piece USING (piece_id) GROUP BY composer""",
    rounds="r",
)
def pearson_tradeoff(s):
    both = s.note.groupBy("piece_id").agg(F.avg("pitch").alias("a"), F.avg("duration_ticks").alias("b")).join(s.piece, "piece_id")
    return resampling.safe_correlation(both, "a", "b", ["composer"])


@query(
    """WITH a AS (SELECT piece_id, CAST(max(pitch) AS DOUBLE) AS v FROM note GROUP BY piece_id), b AS (SELECT piece_id, CAST(max(pitch) AS DOUBLE) AS v FROM output_note GROUP BY piece_id)
    SELECT piece_id, a.v AS first, b.v AS second, b.v - a.v AS difference FROM a JOIN b USING (piece_id)"""
)
def paired_difference(s):
    top = lambda n: n.groupBy("piece_id").agg(F.max("pitch").cast("double").alias("v"))
    return tasks.paired(top(s.note), top(s.output), ["piece_id"], "v")


PAIRS = """SELECT composer, piece_id, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM (SELECT piece_id, avg(velocity) AS a FROM note GROUP BY piece_id) x JOIN (SELECT piece_id, avg(velocity) AS b FROM output_note GROUP BY piece_id) y USING (piece_id) JOIN piece USING (piece_id)"""


def _velocities(s):
    mean = lambda n, c: n.groupBy("piece_id").agg(F.avg("velocity").alias(c))
    return mean(s.note, "a").join(mean(s.output, "b"), "piece_id").join(s.piece.select("piece_id", "composer"), "piece_id")


@query(f"SELECT composer, count(*) AS n, avg(b - a) AS mean_difference, stddev_samp(b - a) AS std_difference, avg(b - a) / (stddev_samp(b - a) / sqrt(count(*))) AS t FROM ({PAIRS}) p GROUP BY composer", rounds="mean_difference std_difference t")
def paired_t_statistic(s):
    return resampling.paired_t(_velocities(s), "a", "b", ["composer"]).drop("p")


@query()
def paired_t_test(s):
    return resampling.paired_t(_velocities(s), "a", "b", ["composer"])


@query(
    f"""WITH d AS (SELECT composer, round(b - a, 3) AS d FROM ({PAIRS}) p), r AS (SELECT *, rank() OVER (PARTITION BY composer ORDER BY abs(d)) + (count(*) OVER (PARTITION BY composer, abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0)
    SELECT composer, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0.0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0.0 END) AS w_minus FROM r GROUP BY composer""",
    rounds="w_plus w_minus",
)
def signed_rank(s):
    pairs = _velocities(s).select("composer", F.lit(0.0).alias("a"), F.round(F.col("b") - F.col("a"), 3).alias("b"))
    return resampling.signed_rank(pairs, "a", "b", ["composer"]).select("composer", "n", "w_plus", "w_minus")


def _responses(s):
    return s.table("events").select(F.col("user_id").alias("respondent_id"), F.col("event_type").alias("dimension"), (1 + F.pmod(F.floor("value"), F.lit(5))).cast("double").alias("value"))


@query(
    """SELECT event_type AS dimension, count(*) AS n, count(DISTINCT user_id) AS respondents, avg(1 + CAST(floor(value) AS BIGINT) % 5) AS mean, stddev_samp(1 + CAST(floor(value) AS BIGINT) % 5) AS std FROM events GROUP BY event_type""",
    rounds="mean std",
)
def survey_stats(s):
    return resampling.survey_stats(_responses(s)).drop("low", "high")


@query()
def survey_intervals(s):
    return resampling.survey_stats(_responses(s))


@query()
def survey_significance(s):
    return resampling.one_sample_t(_responses(s), 3.0)
