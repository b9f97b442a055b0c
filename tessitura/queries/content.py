"""Queries on style vectors, profiles, distances and paired pieces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import features, histograms, melody, profiles, similarity, transform
from ..plans.score import TICKS_PER_BEAT as TPB
from .features import LEGACY, PC, _bins, _legacy_long
from .melody import FLAGS, SWEEP
from .meter import BARS, EMPTY
from .registry import query

MARKED = f"""SELECT *, row_number() OVER (PARTITION BY piece_id, tick ORDER BY pitch DESC, channel, velocity, duration_ticks, ordinal) = 1 AS is_melody, max(pitch) OVER (PARTITION BY piece_id, tick) AS top FROM ({FLAGS}) f"""
REST_NOTES = f"(SELECT * FROM (WITH {BARS} SELECT n.*, b.bar_start, b.bar_end FROM ({MARKED}) n ASOF JOIN bars b ON n.piece_id = b.piece_id AND n.tick >= b.bar_start) x WHERE NOT is_melody)"
STYLE = " UNION ALL ".join([
    f"SELECT piece_id, idx, value FROM ({_bins(REST_NOTES, 'piece_id', 'least((tick - bar_start) * 16 // greatest(bar_end - bar_start, 1), 15)', 16)}) a",
    f"SELECT piece_id, idx + 16, value FROM ({_bins(REST_NOTES, 'piece_id', 'CASE WHEN duration_ticks < 120 THEN 0 WHEN duration_ticks < 240 THEN 1 WHEN duration_ticks < 480 THEN 2 WHEN duration_ticks < 960 THEN 3 WHEN duration_ticks < 1920 THEN 4 ELSE 5 END', 6)}) a",
    f"SELECT piece_id, idx + 22, value FROM ({_bins(REST_NOTES, 'piece_id', 'pitch % 12', 12)}) a",
    f"SELECT piece_id, idx + 34, value FROM ({_bins(REST_NOTES, 'piece_id', 'least(greatest(pitch - top + 12, 0), 24)', 25)}) a",
    f"SELECT piece_id, idx + 59, value FROM ({_bins('(SELECT piece_id, tick, count(*) AS n FROM note GROUP BY piece_id, tick)', 'piece_id', 'least(n - 1, 7)', 8)}) a",
])
GRP = "CASE WHEN idx < 22 THEN 'rhythm' WHEN idx < 59 THEN 'pitch' ELSE 'texture' END"
MEANS = f"""SELECT composer, idx, avg(value) AS mean, CASE WHEN stddev_pop(value) < 1e-6 THEN 1.0 ELSE stddev_pop(value) END AS std, sum(value) AS total FROM ({STYLE}) v JOIN piece USING (piece_id) GROUP BY composer, idx"""


def _structured(s):
    return features.structured_notes(s.note, s.meter, TPB)


def _style(s):
    return features.long_vector(features.style_vector(_structured(s), TPB), features.STYLE_FEATURES)


@query(f"SELECT piece_id, CAST(idx AS INTEGER) AS idx, value FROM ({STYLE}) v", rounds="value")
def style_vector67(s):
    return _style(s).select("piece_id", "idx", "value")


@query(f"SELECT composer, CAST(idx AS INTEGER) AS idx, mean, std, total FROM ({MEANS}) m", rounds="mean std total")
def target_profile(s):
    return profiles.target_profile(_style(s).join(s.piece.select("piece_id", "composer"), "piece_id"), ["composer"])


def _distances(s, root_mean):
    own = _style(s).withColumn("grp", features.group_of(F.col("name"), features.STYLE_GROUPS)) if root_mean else _style(s)
    own = own.withColumn("grp", F.when(F.col("idx") < 22, "rhythm").when(F.col("idx") < 59, "pitch").otherwise("texture"))
    profile = profiles.target_profile(own.join(s.piece.select("piece_id", "composer"), "piece_id"), ["composer"])
    return profiles.grouped_distance(own, profile.withColumnRenamed("composer", "target"), ["idx"], ["piece_id", "target"], root_mean)


@query(f"SELECT piece_id, composer AS target, {GRP} AS grp, sqrt(avg(((value - mean) / std) ** 2)) AS distance FROM ({STYLE}) v JOIN ({MEANS}) m USING (idx) GROUP BY ALL", rounds="distance")
def grouped_rms_distance(s):
    return _distances(s, True)


@query(f"SELECT piece_id, composer AS target, {GRP} AS grp, sqrt(sum(((value - mean) / std) ** 2)) AS distance FROM ({STYLE}) v JOIN ({MEANS}) m USING (idx) GROUP BY ALL", rounds="distance")
def style_l2_distance(s):
    return _distances(s, False)


@query(
    f"""SELECT v.piece_id, m.composer AS target, sqrt(sum((value - mean) ** 2)) AS distance FROM ({LEGACY}) v
    JOIN (SELECT composer, idx, avg(value) AS mean FROM ({LEGACY}) x JOIN piece USING (piece_id) GROUP BY composer, idx) m USING (idx) GROUP BY ALL""",
    rounds="distance",
)
def euclidean_distance(s):
    long = _legacy_long(s)
    means = profiles.corpus_stats(long.join(s.piece.select("piece_id", "composer"), "piece_id"), ["composer"])
    return profiles.euclidean(long, means.select(F.col("composer").alias("target"), "idx", F.col("mean").alias("value")), ["idx"], ["piece_id", "target"])


@query(
    f"""SELECT v.piece_id, sqrt(sum((value - mean) ** 2 / var)) AS distance FROM ({PC}) v
    JOIN (SELECT idx, avg(value) AS mean, var_samp(value) AS var FROM ({PC}) x GROUP BY idx) m USING (idx) GROUP BY v.piece_id""",
    rounds="distance",
)
def mahalanobis_diagonal(s):
    shares = histograms.histogram(s.note, F.pmod("pitch", F.lit(12)), 12)
    stats = shares.select(F.posexplode("values").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v")).orderBy("i").collect()  # 12 rows
    inverse = profiles.pseudo_inverse(np.diag([r.v for r in stats]))
    centre = F.array(*[F.lit(r.m) for r in stats])
    return shares.select("piece_id", profiles.mahalanobis(F.col("values"), centre, inverse).alias("distance"))


@query()
def mahalanobis_distance(s):
    """With the full covariance, by pseudo-inverse."""
    names = [f"pitch_class_{i}" for i in range(12)]
    shares = histograms.histogram(s.note, F.pmod("pitch", F.lit(12)), 12)
    wide = features.spread(shares, "piece_id", "values", names)
    cov = np.zeros((12, 12))
    for r in profiles.covariance(wide.withColumn("every", F.lit(1)), names, ["every"]).collect():  # 78 rows
        cov[r.i, r.j] = cov[r.j, r.i] = r.cov
    means = wide.agg(*[F.avg(n).alias(n) for n in names]).first()
    return shares.select("piece_id", profiles.mahalanobis(F.col("values"), F.array(*[F.lit(x) for x in means]), profiles.pseudo_inverse(cov)).alias("distance"))


@query(
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i)
    SELECT e.vec_id, c.label, sqrt(sum((e.x - c.m) ** 2)) AS distance FROM e JOIN c USING (i) GROUP BY e.vec_id, c.label""",
    rounds="distance",
)
def embedding_centroids(s):
    from ..functions.scalar import masked_euclidean

    e = s.table("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centres = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select("label", F.col("s.x").alias("c"))  # ten labels
    return e.drop("label").join(F.broadcast(centres)).select("vec_id", "label", masked_euclidean(F.col("v"), F.col("c")).alias("distance"))


def _grams(table: str) -> str:
    return f"""SELECT piece_id, a, b, c, count(*) AS n FROM (SELECT piece_id, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c FROM (SELECT * FROM (SELECT piece_id, tick, CAST(sign(p - lag(p) OVER (PARTITION BY piece_id ORDER BY tick)) AS INTEGER) AS x
        FROM (SELECT piece_id, tick, max(pitch) AS p FROM {table} GROUP BY piece_id, tick)) WHERE x IS NOT NULL) WINDOW w AS (PARTITION BY piece_id ORDER BY tick)) WHERE c IS NOT NULL GROUP BY ALL"""


JACCARD = f"""SELECT piece_id, sum(least(coalesce(l.n, 0), coalesce(r.n, 0))) / sum(greatest(coalesce(l.n, 0), coalesce(r.n, 0))) AS melody_trigram_jaccard
    FROM ({_grams("note")}) l FULL JOIN ({_grams("output_note")}) r USING (piece_id, a, b, c) GROUP BY piece_id"""


@query(JACCARD, rounds="melody_trigram_jaccard")
def trigram_multiset_jaccard(s):
    return similarity.contour_similarity(s.note, s.output)


@query(
    """WITH l AS (SELECT piece_id, tick, pitch, count(*) AS n FROM note GROUP BY ALL), r AS (SELECT piece_id, tick, pitch - 3 AS pitch, count(*) AS n FROM output_note GROUP BY ALL)
    SELECT piece_id, CAST(sum(least(coalesce(l.n, 0), coalesce(r.n, 0))) AS BIGINT) AS common, CAST(sum(greatest(coalesce(l.n, 0), coalesce(r.n, 0))) AS BIGINT) AS every,
        sum(least(coalesce(l.n, 0), coalesce(r.n, 0))) / sum(greatest(coalesce(l.n, 0), coalesce(r.n, 0))) AS jaccard FROM l FULL JOIN r USING (piece_id, tick, pitch) GROUP BY piece_id""",
    rounds="jaccard",
)
def event_similarity(s):
    return similarity.multiset_jaccard(s.note, s.output.withColumn("pitch", F.col("pitch") - 3), ["tick", "pitch"])


COSINE = """WITH l AS (SELECT piece_id, pitch % 12 AS pc, CAST(sum(duration_ticks) AS DOUBLE) AS x FROM note GROUP BY ALL), r AS (SELECT piece_id, pitch % 12 AS pc, CAST(sum(duration_ticks) AS DOUBLE) AS y FROM output_note GROUP BY ALL)
    SELECT piece_id, sum(coalesce(x, 0) * coalesce(y, 0)) / (sqrt(sum(coalesce(x, 0) ** 2)) * sqrt(sum(coalesce(y, 0) ** 2))) AS chroma_cosine FROM l FULL JOIN r USING (piece_id, pc) GROUP BY piece_id"""


@query(COSINE, rounds="chroma_cosine")
def chroma_cosine(s):
    return similarity.chroma_cosine(s.note, s.output)


@query(
    """WITH a AS (SELECT DISTINCT piece_id, tick, 1 AS x FROM note), b AS (SELECT DISTINCT piece_id, tick, 1 AS y FROM output_note)
    SELECT piece_id, 2 * count(CASE WHEN x = 1 AND y = 1 THEN 1 END) / (count(x) + count(y)) AS onset_f1 FROM a FULL JOIN b USING (piece_id, tick) GROUP BY piece_id""",
    rounds="onset_f1",
)
def onset_exact_f1(s):
    return similarity.onset_exact_f1(s.note, s.output)


@query()
def onset_f1_greedy(s):
    return similarity.onset_f1(s.note, s.output, TPB / 16)


@query(
    f"""WITH si AS (SELECT piece_id, count(*) AS n, count_if(duration_ticks <= 0) / count(*) AS z, max(tick + duration_ticks) AS e FROM note GROUP BY piece_id),
    so AS (SELECT piece_id, count(*) AS n, count_if(duration_ticks <= 0) / count(*) AS z, max(tick + duration_ticks) AS e FROM output_note GROUP BY piece_id),
    vi AS ({SWEEP.format(n="note")}), vo AS ({SWEEP.format(n="output_note")}), bi AS ({EMPTY})
    SELECT piece_id, si.n AS note_count_input, so.n AS note_count_output, si.e AS end_tick_input, so.e AS end_tick_output, si.z AS zero_duration_ratio_input, so.z AS zero_duration_ratio_output,
        vi.max_polyphony AS max_polyphony_input, vo.max_polyphony AS max_polyphony_output, vi.mean_polyphony AS mean_polyphony_input, vo.mean_polyphony AS mean_polyphony_output,
        bi.bar_count AS bar_count_input, bi.empty_bar_ratio AS empty_bar_ratio_input, abs(so.e - si.e) AS length_error_ticks, abs(so.e - si.e) / greatest(si.e, 1) AS length_error,
        so.n / greatest(si.n, 1) AS note_count_ratio, melody_trigram_jaccard, chroma_cosine
    FROM si JOIN so USING (piece_id) JOIN vi USING (piece_id) JOIN vo USING (piece_id) JOIN bi USING (piece_id) JOIN ({JACCARD}) j USING (piece_id) JOIN ({COSINE}) c USING (piece_id)""",
    rounds="zero_duration_ratio_input zero_duration_ratio_output mean_polyphony_input mean_polyphony_output empty_bar_ratio_input length_error note_count_ratio melody_trigram_jaccard chroma_cosine",
)
def content_metrics(s):
    return similarity.content_metrics(s.note, s.output, s.meter, TPB).select(
        "piece_id", "note_count_input", "note_count_output", "end_tick_input", "end_tick_output", "zero_duration_ratio_input", "zero_duration_ratio_output", "max_polyphony_input", "max_polyphony_output",
        "mean_polyphony_input", "mean_polyphony_output", "bar_count_input", "empty_bar_ratio_input", "length_error_ticks", "length_error", "note_count_ratio", "melody_trigram_jaccard", "chroma_cosine",
    )


@query("SELECT piece_id, true AS semantic_equal FROM (SELECT DISTINCT piece_id FROM note)")
def semantic_equal(s):
    """Notes whose ends are swapped within a pitch are the same events."""
    from pyspark.sql import Window

    off = s.note.withColumn("end", F.col("tick") + F.col("duration_ticks"))
    w = Window.partitionBy("piece_id", "channel", "pitch")
    ons = off.withColumn("k", F.row_number().over(w.orderBy("tick", "velocity"))).drop("duration_ticks", "end")
    offs = off.select("piece_id", "channel", "pitch", "end", F.row_number().over(w.orderBy("end")).alias("k"))
    swapped = ons.join(offs, ["piece_id", "channel", "pitch", "k"]).withColumn("duration_ticks", F.col("end") - F.col("tick"))
    return similarity.semantic_equal(s.note, swapped)


VIOLATIONS = f"""WITH m AS ({MARKED}), w AS (SELECT piece_id, tick, duration_ticks, pitch + 3 AS pitch, channel, velocity, count(*) AS n FROM m WHERE is_melody GROUP BY ALL),
    h AS (SELECT piece_id, tick, duration_ticks, pitch, channel, velocity, count(*) AS n FROM moved GROUP BY ALL),
    lost AS (SELECT piece_id, bool_or(coalesce(h.n, 0) < w.n) AS lost FROM w LEFT JOIN h USING (piece_id, tick, duration_ticks, pitch, channel, velocity) GROUP BY piece_id),
    a AS (SELECT piece_id, count(*) AS n, max(tick + duration_ticks) AS e FROM note GROUP BY piece_id), b AS (SELECT piece_id, count(*) AS n, max(tick + duration_ticks) AS e FROM moved GROUP BY piece_id)
    SELECT piece_id, CAST(lost AS INTEGER) + CAST(abs(a.e - b.e) > 30 OR abs(a.e - b.e) / greatest(a.e, 1) > 0.05 AS INTEGER) + CAST(b.n / a.n NOT BETWEEN 0.9 AND 1.1 AS INTEGER) AS n_violations,
        abs(a.e - b.e) / greatest(a.e, 1) AS length_error, b.n / a.n AS note_count_ratio FROM a JOIN b USING (piece_id) JOIN lost USING (piece_id)"""


@query(
    f"""WITH moved AS (SELECT piece_id, tick, channel, pitch + 3 AS pitch, velocity, CASE WHEN duration_ticks > 400 THEN duration_ticks // 2 ELSE duration_ticks END AS duration_ticks FROM note WHERE pitch % 7 <> 0)
    SELECT * FROM ({VIOLATIONS}) v""",
    rounds="length_error note_count_ratio",
)
def constraint_report(s):
    shorter = F.when(F.col("duration_ticks") > 400, F.floor(F.col("duration_ticks") / 2)).otherwise(F.col("duration_ticks"))
    moved = s.note.where(F.pmod("pitch", F.lit(7)) != 0).withColumn("pitch", F.col("pitch") + 3).withColumn("duration_ticks", shorter)
    limits = s.piece.select("piece_id", F.lit(100).alias("limit"))
    report = similarity.constraint_report(melody.melody_flags(s.note), moved, 3, limits, TPB)
    return report.select("piece_id", F.size("violations").alias("n_violations"), "length_error", "note_count_ratio")


@query()
def local_transform(s):
    """The bar-relative transformation of every piece towards the histograms of
    its own label; the result as counts and sums per piece."""
    long = _style(s).join(s.piece.select("piece_id", "composer"), "piece_id")
    total = long.groupBy("composer", "idx").agg(F.sum("value").alias("v")).groupBy("composer").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("x"))
    hist = total.select("composer", F.slice(F.col("x.v"), 1, 16).alias("onset_hist"), F.slice(F.col("x.v"), 17, 6).alias("duration_hist"))
    notes = _structured(s).join(s.piece.select("piece_id", "composer"), "piece_id").join(F.broadcast(hist), "composer")  # one row per label
    genome = {"transpose": 2.0, "rhythm": 0.5, "duration": 0.5, "thin": 0.2, "double": 0.6}
    moved = transform.local_transform(notes, F.col("onset_hist"), F.col("duration_hist"), F.lit(12), genome, TPB, seed=1)
    return moved.groupBy("piece_id").agg(F.count("*").alias("n"), F.sum("tick").alias("ticks"), F.sum("duration_ticks").alias("lengths"), F.sum("pitch").alias("pitches"))
