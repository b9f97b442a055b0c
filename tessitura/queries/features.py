"""Queries on histograms, keys and feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import comparable, valid_vector
from ..operators import features, histograms, melody, profiles
from ..plans.score import TICKS_PER_BEAT as TPB
from .melody import REST, SIGNS, SWEEP
from .meter import METERED, PLACED
from .registry import query


def _bins(counts: str, key: str, column: str, size: int, weight: str = "1.0") -> str:
    """Long dense shares (key, idx, value) of a bin column."""
    return f"""SELECT k.{key}, CAST(i.i AS INTEGER) AS idx, coalesce(sum(CASE WHEN b = i.i THEN w END), 0.0) / CASE WHEN sum(w) = 0 THEN 1 ELSE sum(w) END AS value
        FROM (SELECT {key}, {column} AS b, {weight} AS w FROM {counts}) k, (SELECT unnest(range({size})) AS i) i GROUP BY ALL"""


def _long(df, key="piece_id"):
    return df.select(key, F.posexplode("values").alias("idx", "value"))


PC = _bins("note", "piece_id", "pitch % 12", 12)


@query(PC, rounds="value")
def pitch_class_hist(s):
    return _long(histograms.histogram(s.note, F.pmod("pitch", F.lit(12)), 12))


STEPS = "(SELECT * FROM (SELECT piece_id, tick, pitch - lag(pitch) OVER (PARTITION BY piece_id ORDER BY tick) AS d FROM skyline) WHERE d IS NOT NULL)"


@query(_bins(STEPS, "piece_id", "least(greatest(d, -12), 12) + 12", 25), rounds="value")
def interval_hist(s):
    steps = melody.successive(melody.skyline(s.note), F.col("pitch"), "d").where("d IS NOT NULL")
    return _long(histograms.histogram(steps, F.least(F.greatest("d", F.lit(-12)), F.lit(12)) + 12, 25))


@query(_bins("note", "piece_id", "CASE WHEN duration_ticks < 120 THEN 0 WHEN duration_ticks < 240 THEN 1 WHEN duration_ticks < 480 THEN 2 WHEN duration_ticks < 960 THEN 3 ELSE 4 END", 5), rounds="value")
def duration_bins(s):
    return _long(histograms.histogram(s.note, histograms.dense_bins(F.col("duration_ticks") / TPB, (0.25, 0.5, 1.0, 2.0)), 5))


CHROMA = _bins("note", "piece_id", "pitch % 12", 12, "CAST(duration_ticks AS DOUBLE)")


@query(f"SELECT piece_id, sum(CASE WHEN value > 0 THEN -value * log2(value) ELSE 0.0 END) AS bits FROM ({CHROMA}) c GROUP BY piece_id", rounds="bits")
def chroma_entropy(s):
    shares = histograms.histogram(s.note, F.pmod("pitch", F.lit(12)), 12, weight=F.col("duration_ticks"))
    return shares.select("piece_id", histograms.entropy(F.col("values")).alias("bits"))


PROFILES = "(VALUES " + ", ".join(f"({o}, '{n}', {i}, {p[i]}::DOUBLE)" for o, n, p in histograms.key_profiles() for i in range(12)) + ") AS pr(key_order, key_name, idx, p)"


def _keys(shares: str) -> str:
    return f"SELECT piece_id, key_order, key_name, corr(value, p) AS r FROM ({shares}) v JOIN {PROFILES} USING (idx) GROUP BY ALL"


@query(f"SELECT piece_id, arg_min(key_name, (-round(r, 12), key_order)) AS key_name FROM ({_keys(PC)}) k GROUP BY piece_id")
def key_estimate(s):
    return histograms.estimated_key(histograms.histogram(s.note, F.pmod("pitch", F.lit(12)), 12))


@query(f"SELECT piece_id, max(r) AS tonal_clarity FROM ({_keys(CHROMA)}) k GROUP BY piece_id", rounds="tonal_clarity")
def tonal_clarity(s):
    return histograms.tonal_clarity(histograms.histogram(s.note, F.pmod("pitch", F.lit(12)), 12, weight=F.col("duration_ticks")))


@query(
    f"""WITH k AS (SELECT piece_id, arg_min(key_name, (-round(r, 12), key_order)) AS key_name FROM ({_keys(PC)}) k GROUP BY piece_id),
    c AS (SELECT composer, key_name, count(*) AS n FROM k JOIN piece USING (piece_id) GROUP BY ALL)
    SELECT composer, arg_min(key_name, (-n, key_name)) AS key_name FROM c GROUP BY composer"""
)
def dominant_key(s):
    keys = histograms.estimated_key(histograms.histogram(s.note, F.pmod("pitch", F.lit(12)), 12))
    return profiles.most_frequent(keys.join(s.piece, "piece_id"), "key_name", ["composer"])


DENSITY = """SELECT piece_id, count(*) / (max(tick + duration_ticks) * any_value(60.0 / (60e6 / tempo) / 480)) AS note_density_per_s,
    avg(duration_ticks) * any_value(60.0 / (60e6 / tempo) / 480) AS mean_note_duration_s, stddev_pop(duration_ticks) * any_value(60.0 / (60e6 / tempo) / 480) AS std_note_duration_s
    FROM note JOIN (SELECT piece_id, tempo FROM tempo) t USING (piece_id) GROUP BY piece_id"""


@query(DENSITY, rounds="note_density_per_s mean_note_duration_s std_note_duration_s")
def density_duration_stats(s):
    wide = features.legacy_vector(s.piece.join(s.note.select("piece_id").distinct(), "piece_id", "left_semi"), s.note, s.tempo, TPB)
    return wide.select("piece_id", "note_density_per_s", "mean_note_duration_s", "std_note_duration_s")


LEGACY = f"""SELECT piece_id, 0 AS idx, 60e6 / tempo AS value FROM tempo JOIN (SELECT DISTINCT piece_id FROM note) USING (piece_id)
    UNION ALL SELECT piece_id, idx + 1, value FROM ({PC}) a
    UNION ALL SELECT piece_id, idx + 13, value FROM ({_bins(STEPS, "piece_id", "least(greatest(d, -12), 12) + 12", 25)}) b
    UNION ALL SELECT piece_id, 38, note_density_per_s FROM ({DENSITY}) c UNION ALL SELECT piece_id, 39, mean_note_duration_s FROM ({DENSITY}) c
    UNION ALL SELECT piece_id, 40, std_note_duration_s FROM ({DENSITY}) c UNION ALL SELECT piece_id, 41, rest_ratio FROM ({REST}) r"""


def _legacy(s):
    with_notes = s.piece.join(s.note.select("piece_id").distinct(), "piece_id", "left_semi")
    return features.legacy_vector(with_notes, s.note, s.tempo, TPB)


def _legacy_long(s):
    return features.long_vector(_legacy(s), features.LEGACY_FEATURES).select("piece_id", "idx", "value")


@query(LEGACY, rounds="value")
def legacy_vector_long(s):
    return _legacy_long(s)


@query(
    f"""SELECT composer, idx, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_pop(value) AS std FROM ({LEGACY}) v JOIN piece USING (piece_id) GROUP BY composer, idx""",
    rounds="mean median std",
)
def corpus_mean_median_std(s):
    return profiles.corpus_stats(_legacy_long(s).join(s.piece.select("piece_id", "composer"), "piece_id"), ["composer"])


@query(
    f"""WITH v AS MATERIALIZED (SELECT composer, piece_id, idx, value FROM ({PC}) p JOIN piece USING (piece_id))
    SELECT a.composer, a.idx AS i, b.idx AS j, coalesce(covar_samp(a.value, b.value), 0.0) AS cov FROM v a JOIN v b ON a.piece_id = b.piece_id AND a.idx <= b.idx GROUP BY ALL""",
    rounds="cov",
)
def corpus_covariance(s):
    names = [f"pitch_class_{i}" for i in range(12)]
    wide = features.spread(histograms.histogram(s.note, F.pmod("pitch", F.lit(12)), 12), "piece_id", "values", names)
    return profiles.covariance(wide.join(s.piece.select("piece_id", "composer"), "piece_id"), names, ["composer"])


@query(
    """WITH l AS (SELECT piece_id, 'n_notes' AS field, CAST(count(*) AS DOUBLE) AS value FROM note GROUP BY piece_id UNION ALL SELECT piece_id, 'mean_pitch', avg(pitch) FROM note GROUP BY piece_id
        UNION ALL SELECT piece_id, 'end_tick', CAST(end_tick AS DOUBLE) FROM ends),
    q AS (SELECT field, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, count(*) AS n FROM l GROUP BY field)
    SELECT field, piece_id, value FROM l JOIN q USING (field) WHERE n >= 4 AND (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))""",
    rounds="value",
)
def iqr_outliers(s):
    stats = s.note.groupBy("piece_id").agg(F.count("*").alias("n_notes"), F.avg("pitch").alias("mean_pitch"), F.max(F.col("tick") + F.col("duration_ticks")).alias("end_tick"))
    return profiles.iqr_outliers(stats, ["n_notes", "mean_pitch", "end_tick"], "piece_id")


CHORDS = """SELECT piece_id, avg(CAST(n >= 2 AS INTEGER)) AS chord_onset_ratio, avg(n) AS chord_size_mean, stddev_pop(n) AS chord_size_std, CAST(max(n) AS DOUBLE) AS chord_size_max, avg(CAST(n = 1 AS INTEGER)) AS monophonic_onset_ratio
    FROM (SELECT piece_id, tick, count(*) AS n FROM note GROUP BY piece_id, tick) c GROUP BY piece_id"""
TEXTURE = f"""SELECT c.*, mean_polyphony, CAST(max_polyphony AS DOUBLE) AS max_polyphony FROM ({CHORDS}) c JOIN ({SWEEP.format(n="note")}) w USING (piece_id)"""


@query(TEXTURE, rounds="chord_onset_ratio chord_size_mean chord_size_std chord_size_max monophonic_onset_ratio mean_polyphony max_polyphony")
def chord_texture(s):
    return features.texture_features(s.note)


@query(
    """WITH n AS (SELECT *, row_number() OVER () AS r FROM note)
    SELECT a.piece_id, avg(CAST(abs(a.pitch - b.pitch) % 12 IN (0, 3, 4, 5, 7, 8, 9) AS INTEGER)) AS consonance, count(*) AS pairs FROM n a JOIN n b ON a.piece_id = b.piece_id AND a.tick = b.tick AND a.r < b.r GROUP BY a.piece_id""",
    rounds="consonance",
)
def chord_consonance(s):
    pairs = features.chord_pairs(s.note)
    return pairs.groupBy("piece_id").agg(F.avg(F.col("interval_class").isin(*features.CONSONANT).cast("double")).alias("consonance"), F.count("*").alias("pairs"))


MOTION = """WITH o AS (SELECT piece_id, tick, list_distinct(list(pitch % 12)) AS c, min(pitch) AS b FROM note GROUP BY piece_id, tick),
    l AS (SELECT *, lag(c) OVER w AS p, lag(b) OVER w AS pb FROM o WINDOW w AS (PARTITION BY piece_id ORDER BY tick))
    SELECT piece_id, avg(len(list_intersect(c, p)) / len(list_distinct(list_concat(c, p)))) AS jaccard, avg(abs(b - pb)) AS bass_motion FROM l WHERE p IS NOT NULL GROUP BY piece_id"""


@query(f"SELECT piece_id, jaccard FROM ({MOTION}) m", rounds="jaccard")
def chroma_jaccard(s):
    return features.successive_chroma(s.note).groupBy("piece_id").agg(F.avg("jaccard").alias("jaccard"))


@query(f"SELECT piece_id, bass_motion FROM ({MOTION}) m", rounds="bass_motion")
def bass_motion(s):
    return features.successive_chroma(s.note).groupBy("piece_id").agg(F.avg("bass_step").alias("bass_motion"))


def _unpivot(wide: str, columns: list[str], first: int) -> str:
    return " UNION ALL ".join(f"SELECT piece_id, {first + i} AS idx, CAST({c} AS DOUBLE) AS value FROM ({wide}) u" for i, c in enumerate(columns))


_PITCH = "SELECT piece_id, max(pitch) - min(pitch) AS a, avg(pitch) AS b, stddev_pop(pitch) AS c FROM note GROUP BY piece_id"
_MELODY = f"""SELECT piece_id, avg(d) AS a, stddev_pop(d) AS b, avg(abs(d)) AS c, stddev_pop(abs(d)) AS e, avg(CAST(d > 0 AS INTEGER)) AS f, avg(CAST(d < 0 AS INTEGER)) AS g,
    avg(CAST(d = 0 AS INTEGER)) AS h, avg(CAST(abs(d) <= 2 AS INTEGER)) AS i, avg(CAST(abs(d) >= 5 AS INTEGER)) AS j FROM {STEPS} s GROUP BY piece_id"""
_BIGRAM = f"(WITH {SIGNS}, g AS (SELECT piece_id, x AS a, lead(x) OVER (PARTITION BY piece_id ORDER BY tick) AS b FROM c WHERE x IS NOT NULL) SELECT * FROM g WHERE b IS NOT NULL)"
_RHYTHM = """SELECT piece_id, avg(duration_ticks / 480) AS a, stddev_pop(duration_ticks / 480) AS b, quantile_cont(duration_ticks / 480, 0.5) AS c, stddev_pop(duration_ticks / 480) / avg(duration_ticks / 480) AS e FROM note GROUP BY piece_id"""
_GAPS = "(SELECT * FROM (SELECT piece_id, tick, tick - lag(tick) OVER (PARTITION BY piece_id ORDER BY tick) AS d FROM skyline) WHERE d IS NOT NULL)"
_IOI = f"SELECT piece_id, avg(d / 480) AS a, stddev_pop(d / 480) AS b, stddev_pop(d / 480) / avg(d / 480) AS c FROM {_GAPS} g GROUP BY piece_id"
_METRIC = f"""SELECT piece_id, avg(CAST(bp = 0 AS INTEGER)) AS a, avg(CAST(pp = 0 AS INTEGER)) AS b, avg(CAST(pp * 2 = 1920 AS INTEGER)) AS c FROM ({PLACED.format(m=METERED.format(n="(SELECT DISTINCT piece_id, tick, 0 AS duration_ticks FROM note)"))}) y GROUP BY piece_id"""
_SYNC = f"SELECT piece_id, avg(CAST(pp > 0 AND duration_ticks * denominator > 1920 - pp AS INTEGER)) AS a FROM ({PLACED.format(m=METERED.format(n='note'))}) y GROUP BY piece_id"
_CONS = """WITH n AS (SELECT *, row_number() OVER () AS r FROM note), p AS (SELECT a.piece_id, avg(CAST(abs(a.pitch - b.pitch) % 12 IN (0, 3, 4, 5, 7, 8, 9) AS INTEGER)) AS a FROM n a JOIN n b ON a.piece_id = b.piece_id AND a.tick = b.tick AND a.r < b.r GROUP BY a.piece_id)
    SELECT piece_id, coalesce(p.a, 0.0) AS a FROM (SELECT DISTINCT piece_id FROM note) x LEFT JOIN p USING (piece_id)"""


def _grams(rows: str) -> str:
    return f"""SELECT piece_id, 1 - count(DISTINCT (x, y, z)) / count(*) AS a, count(DISTINCT (x, y, z)) / count(*) AS b FROM
        (SELECT piece_id, x, lead(x) OVER w AS y, lead(x, 2) OVER w AS z FROM {rows} r WINDOW w AS (PARTITION BY piece_id ORDER BY tick)) WHERE z IS NOT NULL GROUP BY piece_id"""


def _lags(rows: str) -> str:
    return ("SELECT piece_id, greatest(" + ", ".join(f"avg(CAST(x = l{k} AS INTEGER))" for k in range(1, 9)) + ") AS a FROM (SELECT *, "
            + ", ".join(f"lag(x, {k}) OVER (PARTITION BY piece_id ORDER BY tick) AS l{k}" for k in range(1, 9)) + f" FROM {rows} r) z GROUP BY piece_id")


_PX = "(SELECT piece_id, tick, pitch % 12 AS x FROM skyline)"
_RX = f"(SELECT piece_id, tick, CAST(round_even(d / 480 * 8, 0) AS BIGINT) AS x FROM {_GAPS} g)"
COMPOSITION = " UNION ALL ".join([
    _unpivot(_PITCH, ["a", "b", "c"], 0), f"SELECT piece_id, 3 AS idx, sum(CASE WHEN value > 0 THEN -value * log2(value) ELSE 0.0 END) AS value FROM ({PC}) c GROUP BY piece_id",
    f"SELECT piece_id, idx + 4, value FROM ({PC}) c", _unpivot(_MELODY, list("abcefghij"), 16),
    f"SELECT piece_id, idx + 25, value FROM ({_bins(STEPS, 'piece_id', 'least(abs(d), 12)', 13)}) c", f"SELECT piece_id, idx + 38, value FROM ({_bins(_BIGRAM, 'piece_id', '(a + 1) * 3 + b + 1', 9)}) c",
    _unpivot(_RHYTHM, list("abce"), 47),
    f"SELECT piece_id, idx + 51, value FROM ({_bins('note', 'piece_id', 'CASE WHEN duration_ticks < 120 THEN 0 WHEN duration_ticks < 240 THEN 1 WHEN duration_ticks < 480 THEN 2 WHEN duration_ticks < 960 THEN 3 ELSE 4 END', 5)}) c",
    _unpivot(_IOI, list("abc"), 56), _unpivot(_METRIC, list("abc"), 59), _unpivot(_SYNC, ["a"], 62),
    _unpivot(TEXTURE, ["mean_polyphony", "max_polyphony", "chord_onset_ratio", "chord_size_mean", "chord_size_std", "chord_size_max", "monophonic_onset_ratio"], 63),
    f"SELECT piece_id, idx + 70, value FROM ({CHROMA}) c", f"SELECT piece_id, 82, sum(CASE WHEN value > 0 THEN -value * log2(value) ELSE 0.0 END) FROM ({CHROMA}) c GROUP BY piece_id",
    f"SELECT piece_id, 83, max(r) FROM ({_keys(CHROMA)}) k GROUP BY piece_id", _unpivot(_CONS, ["a"], 84), _unpivot(MOTION, ["jaccard", "bass_motion"], 85),
    _unpivot(_grams(_PX), ["a", "b"], 87), _unpivot(_grams(_RX), ["a", "b"], 89), _unpivot(_lags(_PX), ["a"], 91), _unpivot(_lags(_RX), ["a"], 92),
])


@query(f"SELECT piece_id, CAST(idx AS INTEGER) AS idx, value FROM ({COMPOSITION}) v", rounds="value")
def composition_vector(s):
    wide = features.composition_vector(s.note, s.meter, TPB)
    return features.long_vector(wide, features.COMPOSITION_FEATURES).select("piece_id", "idx", "value")


@query(f"SELECT piece_id, CAST(idx AS INTEGER) AS idx, value FROM ({COMPOSITION}) v WHERE idx NOT BETWEEN 47 AND 62", rounds="value")
def variant_projection(s):
    names = set(features.variants()["without_rhythm"])
    wide = features.composition_vector(s.note, s.meter, TPB)
    return features.long_vector(wide, features.COMPOSITION_FEATURES).where(F.col("name").isin(*names)).select("piece_id", "idx", "value")


@query(
    """WITH m AS (SELECT piece_id, [avg(pitch), CASE WHEN piece_id % 5 = 0 THEN 'nan'::DOUBLE ELSE avg(velocity) END, CASE WHEN piece_id % 7 = 0 THEN 'inf'::DOUBLE ELSE avg(duration_ticks) END] AS v FROM note GROUP BY piece_id),
    n AS (SELECT piece_id, CASE WHEN piece_id % 11 = 0 THEN [] WHEN piece_id % 3 = 0 THEN v[1:2] ELSE v END AS v FROM m),
    o AS (SELECT piece_id, len(v) AS size, len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS valid FROM n)
    SELECT piece_id, valid, valid AND size = 3 AS comparable FROM o"""
)
def distance_inputs(s):
    """Which vectors a distance is defined for, and with one of three numbers."""
    of = F.col("piece_id")
    means = s.note.groupBy("piece_id").agg(*(F.avg(c).alias(c) for c in ("pitch", "velocity", "duration_ticks")))
    whole = F.array(F.col("pitch"), F.when(of % 5 == 0, F.lit(float("nan"))).otherwise(F.col("velocity")), F.when(of % 7 == 0, F.lit(float("inf"))).otherwise(F.col("duration_ticks")))
    v = F.when(of % 11 == 0, F.array().cast("array<double>")).when(of % 3 == 0, F.slice(whole, 1, 2)).otherwise(whole)
    other = F.array(F.lit(60.0), F.lit(64.0), F.lit(240.0))
    return means.withColumn("v", v).select("piece_id", valid_vector(F.col("v")).alias("valid"), comparable(F.col("v"), other).alias("comparable"))
