"""Queries on task matrices, histories and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genetic, tasks
from ..plans.score import OUTPUT_GENOME
from ..plans.score import TICKS_PER_BEAT as TPB
from .features import LEGACY
from .registry import query
from .statistics import _h

MATRIX = """SELECT 'full' AS phase, 0 AS repeat, p.fold, p.piece_id AS source_id, p.composer AS source_label, l.composer AS target_label,
    format('full__r00__f{:02d}__{}__{}', p.fold, p.piece_id, l.composer) AS task_id FROM piece p JOIN (SELECT DISTINCT composer FROM piece) l ON l.composer <> p.composer"""


def _matrix(s):
    return tasks.task_matrix(s.piece.select("fold", F.col("piece_id").alias("source_id"), F.col("composer").alias("source_label")), s.piece.select(F.col("composer").alias("label")), "full")


@query(f"""SELECT *, sha256('{{"phase":"full","repeat":0,"fold":' || fold || ',"source_id":' || source_id || ',"source_label":"' || source_label || '","target_label":"' || target_label || '"}}') AS signature FROM ({MATRIX}) m""")
def task_matrix(s):
    return _matrix(s)


def _results(s):
    m = _matrix(s).where("source_id % 3 <> 0")
    return m.withColumn("status", F.when(F.pmod("source_id", F.lit(5)) == 0, "failed").otherwise("completed")).withColumn("signature", F.when(F.pmod("source_id", F.lit(7)) == 0, "stale").otherwise(F.col("signature")))


@query(f"SELECT task_id FROM ({MATRIX}) m WHERE source_id % 3 = 0 OR source_id % 5 = 0 OR source_id % 7 = 0")
def pending_tasks(s):
    return tasks.pending(_matrix(s), _results(s)).select("task_id")


@query(f"SELECT task_id FROM ({MATRIX}) m WHERE NOT (source_id % 3 = 0 OR source_id % 5 = 0 OR source_id % 7 = 0)")
def completed_tasks(s):
    return tasks.completed(_matrix(s), _results(s)).select("task_id")


@query(f"SELECT CASE WHEN source_id % 3 = 0 THEN 'pending' WHEN source_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, count(*) AS n FROM ({MATRIX}) m GROUP BY 1")
def task_status(s):
    return tasks.task_status(_matrix(s), _results(s))


@query(f"SELECT source_id, 'targets' AS problem FROM ({MATRIX}) m WHERE NOT (source_id % 4 = 0 AND target_label = 'ASIA') GROUP BY source_id HAVING count(*) <> 4")
def matrix_problems(s):
    return tasks.matrix_problems(_matrix(s).where("NOT (source_id % 4 = 0 AND target_label = 'ASIA')"), 4)


@query(
    """WITH a AS (SELECT fold, piece_id, composer, CAST(piece_id % 17 AS DOUBLE) AS v FROM piece), b AS (SELECT fold, piece_id, composer, CAST(piece_id % 13 AS DOUBLE) AS v FROM piece WHERE piece_id % 4 <> 0)
    SELECT fold, piece_id, composer, a.v AS first, b.v AS second, b.v - a.v AS difference FROM a JOIN b USING (fold, piece_id, composer)"""
)
def paired_tasks(s):
    a = s.piece.withColumn("v", F.pmod("piece_id", F.lit(17)).cast("double"))
    b = s.piece.where("piece_id % 4 <> 0").withColumn("v", F.pmod("piece_id", F.lit(13)).cast("double"))
    return tasks.paired(a, b, ["fold", "piece_id", "composer"], "v")


HISTORY = "SELECT user_id % 100 AS task, event_id AS generation, floor(value) AS best FROM events"


def _history(s):
    return s.table("events").select(F.pmod("user_id", F.lit(100)).alias("task"), F.col("event_id").alias("generation"), F.floor("value").cast("double").alias("best"))


@query(f"SELECT task, generation, max(best) OVER (PARTITION BY task ORDER BY generation ROWS UNBOUNDED PRECEDING) AS best_so_far FROM ({HISTORY}) h")
def running_best(s):
    return tasks.running_best(_history(s), ["task"], "generation", "best").select("task", "generation", "best_so_far")


@query(
    f"""WITH r AS (SELECT *, best > coalesce(max(best) OVER (PARTITION BY task ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) + 1e-12 AS rose, row_number() OVER (PARTITION BY task ORDER BY generation) AS i FROM ({HISTORY}) h)
    SELECT task, generation, i - max(CASE WHEN rose THEN i END) OVER (PARTITION BY task ORDER BY generation ROWS UNBOUNDED PRECEDING) AS stagnation FROM r"""
)
def stagnation(s):
    return tasks.running_best(_history(s), ["task"], "generation", "best").select("task", "generation", "stagnation")


@query(f"SELECT * FROM (SELECT task, generation, best, CAST(row_number() OVER (PARTITION BY task ORDER BY best DESC, generation) AS INTEGER) AS rank FROM ({HISTORY}) h) r WHERE rank <= 3")
def elite_topk(s):
    return tasks.elites(_history(s), ["task"], "best", "generation", 3)


@query(
    f"""WITH p AS (SELECT group_id % 5 AS pop, row_number() OVER (PARTITION BY group_id % 5 ORDER BY piece_id) - 1 AS idx, (piece_id * 31 % 97)::DOUBLE AS fitness FROM piece), c AS (SELECT pop, count(*) AS n FROM p GROUP BY pop),
    d AS (SELECT pop, r AS round, d AS draw, CAST({_h("'8'", "pop", "r", "d")} % n AS BIGINT) AS idx FROM c, (SELECT unnest(range(20)) AS r), (SELECT unnest(range(3)) AS d))
    SELECT pop, CAST(round AS INTEGER) AS round, arg_min(idx, (-fitness, draw)) AS winner FROM d JOIN p USING (pop, idx) GROUP BY pop, round"""
)
def tournament(s):
    from pyspark.sql import Window

    pop = s.piece.select(F.pmod("group_id", F.lit(5)).alias("pop"), "piece_id", F.pmod(F.col("piece_id") * 31, F.lit(97)).cast("double").alias("fitness"))
    pop = pop.withColumn("idx", (F.row_number().over(Window.partitionBy("pop").orderBy("piece_id")) - 1).cast("long"))
    return tasks.tournament(pop, ["pop"], "idx", "fitness", 20, 3, 8)


@query(
    f"""WITH p AS (SELECT composer, piece_id, row_number() OVER (PARTITION BY composer ORDER BY piece_id) - 1 AS spot FROM piece), c AS (SELECT composer, count(*) AS n, row_number() OVER (ORDER BY composer) - 1 AS li, max(count(*)) OVER () AS most, count(*) OVER () AS labels FROM piece GROUP BY composer),
    d AS (SELECT composer, d * labels + li AS position, CAST({_h("'3'", "composer", "d")} % n AS BIGINT) AS spot FROM (SELECT *, unnest(range(most)) AS d FROM c))
    SELECT position, composer, piece_id FROM d JOIN p USING (composer, spot)"""
)
def balanced_sampler(s):
    return tasks.balanced_draws(s.piece, "composer", "piece_id", 3)


@query("SELECT composer, fold, piece_id FROM (SELECT composer, fold, piece_id, row_number() OVER (PARTITION BY composer, fold ORDER BY piece_id) AS r FROM piece) WHERE r <= 2")
def smoke_selection(s):
    return tasks.per_label_first(s.piece.select("composer", "fold", "piece_id"), ["composer", "fold"], "piece_id", 2)


@query(f"SELECT piece_id, CAST((group_id % 5 + 1 + CAST({_h(chr(39) + '2' + chr(39), 'piece_id')} % 4 AS BIGINT)) % 5 AS BIGINT) AS target FROM piece")
def random_other_label(s):
    return s.piece.select("piece_id", tasks.random_other_label(F.pmod("group_id", F.lit(5)), 5, 2, F.col("piece_id")).cast("long").alias("target"))


def _global_tasks(s, which=None):
    """Tasks with the tempo of their source and the mean vector of their target."""
    from ..operators import meter
    from ..operators.exact import exact_means
    from ..plans.checkpoints import checkpoint
    from .features import _legacy_long

    # Rounded, so that the last bits of a piece's own features don't differ between runs.
    met = _legacy_long(s).withColumn("value", F.round("value", 9)).join(s.piece.select("piece_id", F.col("composer").alias("target_label")), "piece_id")
    met = checkpoint(met.select("target_label", "idx", "value"))
    stats = exact_means(met, ["target_label", "idx"]).select("target_label", "idx", F.col("mean").alias("target"))
    m = _matrix(s) if which is None else which(_matrix(s))
    bpm = meter.mean_tempo(s.piece, s.tempo).select(F.col("piece_id").alias("source_id"), F.col("tempo_bpm").alias("bpm"))
    return m.join(bpm, "source_id").join(F.broadcast(genetic.arrays_by_label(stats, "target_label", ["target"])), "target_label")  # a row per label


def inverse_covariances(s):
    """Pseudo-inverses of the features' covariances by label: 42 by 42 each."""
    import numpy as np

    from ..operators import features, profiles
    from ..operators.exact import exact_covariances
    from ..plans.checkpoints import checkpoint
    from .features import _legacy

    names, inverse = list(features.LEGACY_FEATURES), {}
    wide = _legacy(s).select("piece_id", *[F.round(c, 9).alias(c) for c in names]).join(s.piece.select("piece_id", "composer"), "piece_id")
    for r in exact_covariances(checkpoint(wide), names, ["composer"]).collect():  # a row a label
        of = np.zeros((len(names), len(names)))
        of[np.triu_indices(len(names))] = r.cov
        inverse[r.composer] = profiles.pseudo_inverse(of + np.triu(of, 1).T)
    return inverse


@query()
def ga_search4(s):
    return genetic.search_global(_global_tasks(s), s.note, None, TPB, population=16, generations=8, patience=6)


@query()
def ga_search4_mahalanobis(s):
    return genetic.search_global(_global_tasks(s), s.note, inverse_covariances(s), TPB, population=16, generations=8, patience=6)


def local_tasks(s):
    """Tasks with the style profile and polyphony of their target, and their source's bars."""
    from ..operators import features, intervals, meter, profiles
    from ..plans.checkpoints import checkpoint

    style = features.long_vector(features.style_vector(features.structured_notes(s.note, s.meter, TPB), TPB), features.STYLE_FEATURES)
    profile = profiles.target_profile(style.join(s.piece.select("piece_id", F.col("composer").alias("target_label")), "piece_id"), ["target_label"])
    arrays = genetic.arrays_by_label(checkpoint(profile), "target_label", ["mean", "std", "total"])
    voices = intervals.polyphony(s.note).join(s.piece, "piece_id").groupBy(F.col("composer").alias("target_label")).agg(F.max("max_polyphony").cast("int").alias("limit"))
    bars = meter.bars(s.meter, intervals.end_ticks(s.note), TPB).groupBy(F.col("piece_id").alias("source_id")).agg(F.array_sort(F.collect_list(F.struct("bar_start", "bar_end"))).alias("b"))
    bars = bars.select("source_id", F.col("b.bar_start").alias("bar_starts"), F.col("b.bar_end").alias("bar_ends"))
    return _matrix(s).join(F.broadcast(arrays.join(voices, "target_label")), "target_label").join(bars, "source_id")  # a row per label


@query()
def ga_search5(s):
    return genetic.search_local(local_tasks(s), s.note, TPB, population=16, generations=8, patience=6)


def _few_results(s):
    """Searches of the tasks that have no result yet: every third source's."""
    from ..plans.checkpoints import checkpoint

    pending = _global_tasks(s, lambda tasks: tasks.where("source_id % 3 = 0"))
    return checkpoint(genetic.run_global(pending, s.note, None, TPB, population=12, generations=5, patience=4))


@query(f"SELECT task_id, 0::BIGINT AS differ FROM ({MATRIX}) m WHERE source_id % 3 = 0 AND source_id IN (SELECT piece_id FROM note)")
def ga_result_notes(s):
    """How many notes of a search's output are not those of the relational
    transformation of its source under the genome that it returned."""
    from ..operators.transform import transform_notes

    found = _few_results(s)
    best = genetic.search_results(found)
    genes = best.select("task_id", *[F.col(g).alias(f"g_{g}") for g in genetic.GLOBAL_GENES]).join(_matrix(s).select("task_id", "source_id"), "task_id")
    fields = ["task_id", "tick", "channel", "pitch", "velocity", "duration_ticks"]
    moved = transform_notes(s.note.join(genes, F.col("piece_id") == F.col("source_id")), *[F.col(f"g_{g}") for g in genetic.GLOBAL_GENES]).select(*fields)
    both = moved.withColumn("n", F.lit(1)).unionAll(genetic.search_notes(found).select(*fields).withColumn("n", F.lit(-1)))
    wrong = both.groupBy(*fields).agg(F.sum("n").alias("n")).where("n <> 0").groupBy("task_id").agg(F.sum(F.abs("n")).alias("differ"))
    return best.select("task_id").join(wrong, "task_id", "left").na.fill(0, ["differ"])


@query()
def ga_results(s):
    """The final genome of every pending task, and the digest of its MIDI file."""
    from ..sources import midi

    found = _few_results(s)
    source = _matrix(s).select("task_id", "source_id")
    meta = s.meta.join(source, F.col("piece_id") == F.col("source_id")).select("task_id", *[c for c in s.meta.columns if c != "piece_id"])
    files = midi.encoded(genetic.search_notes(found), meta, TPB, key="task_id").select("task_id", F.sha2("content", 256).alias("file"))
    return genetic.search_results(found).join(files, "task_id", "left")


OUT_LEGACY = f"SELECT * FROM (WITH note AS (SELECT * FROM output_note), skyline AS (SELECT piece_id, tick, max(pitch) AS pitch FROM output_note GROUP BY piece_id, tick), ends AS (SELECT piece_id, max(tick + duration_ticks) AS end_tick FROM output_note GROUP BY piece_id) SELECT piece_id, CAST(idx AS INTEGER) AS idx, value FROM ({LEGACY}) v) x"


@query(OUT_LEGACY, rounds="value")
def search_candidate_features(s):
    """What the searches measure of a candidate, for every piece under one genome."""
    g = OUTPUT_GENOME
    return genetic.measured(s.note, s.tempo, (g["transpose"], g["density"], g["duration"], g["velocity"]), TPB)
