"""Queries on splits, contracts, classification and its metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, evaluation, features, histograms
from ..plans.checkpoints import checkpoint
from ..plans.score import TICKS_PER_BEAT as TPB
from .features import PC
from .registry import query

CENTROID = f"""WITH v AS MATERIALIZED (SELECT p.*, v.idx, v.value FROM ({PC}) v JOIN piece p USING (piece_id)),
    m AS (SELECT f.fold, t.composer, t.idx, avg(t.value) AS mean FROM (SELECT DISTINCT fold FROM piece) f JOIN v t ON t.fold <> f.fold GROUP BY ALL),
    d AS (SELECT v.piece_id, v.group_id, v.fold, v.composer AS true_label, m.composer AS guess, round(sqrt(sum((v.value - m.mean) ** 2)), 6) + 0.0 AS d FROM v JOIN m USING (fold, idx) GROUP BY ALL)
    SELECT piece_id, group_id, fold, true_label, arg_min(guess, (d, guess)) AS predicted_label, min(d) AS distance FROM d GROUP BY ALL"""


def predictions(s):
    long = histograms.histogram(s.note, F.pmod("pitch", F.lit(12)), 12).select("piece_id", F.posexplode("values").alias("idx", "value"))
    return evaluation.centroid_predictions(long, s.piece).join(s.piece.select("piece_id", "group_id"), "piece_id")


@query(CENTROID, rounds="distance")
def centroid_predictions(s):
    return predictions(s).select("piece_id", "group_id", "fold", "true_label", "predicted_label", "distance")


@query(f"SELECT true_label, predicted_label, count(*) AS n FROM ({CENTROID}) p GROUP BY ALL")
def confusion_matrix(s):
    return evaluation.confusion(predictions(s), [])


CLASS = f"""WITH p AS MATERIALIZED ({CENTROID}), t AS (SELECT true_label AS label, count(*) AS support, count_if(true_label = predicted_label) AS tp FROM p GROUP BY 1), c AS (SELECT predicted_label AS label, count(*) AS claimed FROM p GROUP BY 1)
    SELECT label, coalesce(support, 0) AS support, CASE WHEN coalesce(support, 0) = 0 THEN 0.0 ELSE tp / support END AS recall, CASE WHEN coalesce(claimed, 0) = 0 THEN 0.0 ELSE coalesce(tp, 0) / claimed END AS precision,
        2 * coalesce(tp, 0) / (coalesce(support, 0) + coalesce(claimed, 0)) AS f1 FROM t FULL JOIN c USING (label)"""


@query(CLASS, rounds="recall precision f1")
def class_metrics(s):
    return evaluation.class_metrics(predictions(s), [])


@query(f"SELECT avg(recall) AS balanced_accuracy FROM ({CLASS}) m WHERE support > 0", rounds="balanced_accuracy")
def balanced_accuracy(s):
    return evaluation.summary_metrics(predictions(s), []).select("balanced_accuracy")


@query(f"SELECT avg(f1) AS macro_f1 FROM ({CLASS}) m WHERE support > 0", rounds="macro_f1")
def macro_f1(s):
    return evaluation.summary_metrics(predictions(s), []).select("macro_f1")


@query(f"SELECT true_label, fold, count(*) AS n, CAST(count_if(true_label = predicted_label) AS BIGINT) AS correct, count_if(true_label = predicted_label) / count(*) AS accuracy FROM ({CENTROID}) p GROUP BY GROUPING SETS ((true_label), (true_label, fold))", rounds="accuracy")
def oof_grouping_sets(s):
    return evaluation.oof_grouping_sets(predictions(s), ["true_label"], "fold")


@query(f"SELECT 'form' || group_id % 4 AS form, count(*) AS n, avg(CAST(true_label = predicted_label AS INTEGER)) AS accuracy FROM ({CENTROID}) p GROUP BY 1", rounds="accuracy")
def form_accuracy(s):
    return evaluation.form_accuracy(predictions(s).withColumn("form", F.concat(F.lit("form"), F.pmod("group_id", F.lit(4)))), "form")


@query(f"SELECT group_id, count(*) AS errors, CAST(row_number() OVER (ORDER BY count(*) DESC, group_id) AS INTEGER) AS rank FROM ({CENTROID}) p WHERE true_label <> predicted_label GROUP BY group_id")
def misclassified_rank(s):
    return evaluation.misclassified(predictions(s), "group_id")


@query(f"""WITH p AS ({CENTROID}), l AS (SELECT DISTINCT composer AS label FROM piece) SELECT piece_id, label, CASE WHEN label = predicted_label THEN 1 / (1 + distance) ELSE 0.0 END AS probability FROM p, l""", rounds="probability")
def probability_alignment(s):
    scores = predictions(s).select("piece_id", F.col("predicted_label").alias("label"), (1 / (1 + F.col("distance"))).alias("probability"))
    return evaluation.aligned_probabilities(scores, s.piece.select(F.col("composer").alias("label")).distinct(), ["piece_id"])


DRAWS = f"""WITH e AS (SELECT DISTINCT group_id, composer, d AS draw FROM piece, (SELECT unnest(range(10)) AS d)),
    o AS (SELECT draw, group_id, row_number() OVER (PARTITION BY draw ORDER BY group_id) AS spot FROM e),
    z AS (SELECT draw, composer, row_number() OVER (PARTITION BY draw ORDER BY CASE WHEN draw = 0 THEN group_id::UBIGINT ELSE CAST(('0x' || substr(sha256('12|' || draw || '|' || group_id), 1, 16)) AS UBIGINT) END, group_id) AS spot FROM e),
    v AS MATERIALIZED (SELECT draw, p.piece_id, p.fold, z.composer, idx, value FROM o JOIN z USING (draw, spot) JOIN piece p USING (group_id) JOIN ({PC}) v USING (piece_id)),
    m AS (SELECT t.draw, f.fold, t.composer, t.idx, avg(t.value) AS mean FROM (SELECT DISTINCT fold FROM piece) f JOIN v t ON t.fold <> f.fold GROUP BY ALL),
    s AS (SELECT draw, piece_id, v.composer AS true_label, m.composer AS guess, round(sqrt(sum((value - mean) ** 2)), 6) + 0.0 AS d FROM v JOIN m USING (draw, fold, idx) GROUP BY ALL),
    b AS (SELECT draw, piece_id, true_label, arg_min(guess, (d, guess)) AS predicted_label FROM s GROUP BY ALL)
    SELECT CAST(draw AS INTEGER) AS draw, avg(CAST(true_label = predicted_label AS INTEGER)) AS accuracy FROM b GROUP BY draw"""


def _draws(s):
    long = histograms.histogram(s.note, F.pmod("pitch", F.lit(12)), 12).select("piece_id", F.posexplode("values").alias("idx", "value"))
    return evaluation.retrained_permutation(long, s.piece, 9, 12)


@query(DRAWS, rounds="accuracy")
def retrained_permutation(s):
    return _draws(s)


@query(f"SELECT max(CASE WHEN draw = 0 THEN accuracy END) AS observed, (count(CASE WHEN draw > 0 AND accuracy >= (SELECT accuracy FROM ({DRAWS}) o WHERE draw = 0) - 1e-12 THEN 1 END) + 1) / 10.0::DOUBLE AS p FROM ({DRAWS}) d", rounds="observed p")
def retrained_permutation_p(s):
    return evaluation.permutation_p(_draws(s))


@query("SELECT fold, composer, count(*) AS n FROM piece GROUP BY GROUPING SETS ((fold), (fold, composer))")
def split_counts(s):
    return contracts.split_counts(s.piece, ["fold"], "composer")


@query(
    """WITH t AS (SELECT * FROM piece WHERE fold <> 0), e AS (SELECT * FROM piece WHERE fold = 0 OR piece_id % 10 = 0)
    SELECT DISTINCT 'piece_id' AS field, CAST(piece_id AS VARCHAR) AS value FROM t SEMI JOIN e USING (piece_id)
    UNION ALL SELECT DISTINCT 'group_id', CAST(group_id AS VARCHAR) FROM t SEMI JOIN e USING (group_id)"""
)
def group_leakage(s):
    train, test = s.piece.where("fold <> 0"), s.piece.where("fold = 0 OR piece_id % 10 = 0")
    return contracts.leakage(train, test, ["piece_id", "group_id"], [])


@query("SELECT group_id, count(DISTINCT piece_id % 2) AS n_splits FROM piece GROUP BY group_id HAVING count(DISTINCT piece_id % 2) > 1")
def group_crossings(s):
    return contracts.group_crossings(s.piece.withColumn("half", F.pmod("piece_id", F.lit(2))), "group_id", "half")


@query(
    """WITH f AS (SELECT piece_id FROM piece WHERE piece_id % 7 <> 0 UNION ALL SELECT piece_id FROM piece WHERE piece_id % 5 = 0)
    SELECT piece_id, coalesce(n, 0) AS times FROM piece LEFT JOIN (SELECT piece_id, count(*) AS n FROM f GROUP BY piece_id) c USING (piece_id) WHERE coalesce(n, 0) <> 1"""
)
def fold_cover(s):
    folds = s.piece.where("piece_id % 7 <> 0").unionByName(s.piece.where("piece_id % 5 = 0")).select("piece_id")
    return contracts.fold_cover(s.piece.select("piece_id"), folds, "piece_id")


CONTRACT = """SELECT coalesce(e.{k}, a.{k}) AS {k}, CASE WHEN a.{k} IS NULL THEN 'missing' WHEN e.{k} IS NULL THEN 'unexpected' WHEN e.f <> a.f THEN 'mismatch' END AS problem
    FROM ({e}) e FULL JOIN ({a}) a ON e.{k} = a.{k} WHERE a.{k} IS NULL OR e.{k} IS NULL OR e.f <> a.f"""


@query(CONTRACT.format(k="piece_id", e="SELECT piece_id, group_id AS f FROM piece", a="SELECT piece_id + CASE WHEN piece_id % 11 = 0 THEN 1000000 ELSE 0 END AS piece_id, group_id + CASE WHEN piece_id % 13 = 0 THEN 1 ELSE 0 END AS f FROM piece"))
def cache_contract(s):
    actual = s.piece.select((F.col("piece_id") + F.when(F.pmod("piece_id", F.lit(11)) == 0, 1000000).otherwise(0)).alias("piece_id"), (F.col("group_id") + F.when(F.pmod("piece_id", F.lit(13)) == 0, 1).otherwise(0)).alias("group_id"))
    return contracts.row_contract(s.piece, actual, ["piece_id"], ["group_id"])


@query("SELECT piece_id, CASE WHEN piece_id % 9 = 0 THEN 'missing' ELSE 'duplicate' END AS problem FROM piece WHERE piece_id % 9 = 0 OR piece_id % 8 = 0")
def oof_contract(s):
    expected = s.piece.select("piece_id", "composer")
    actual = expected.where("piece_id % 9 <> 0")
    return contracts.row_contract(expected, actual.unionByName(actual.where("piece_id % 8 = 0")), ["piece_id"], ["composer"])


H = "CAST(('0x' || substr(sha256({k}), 1, 16)) AS UBIGINT)"


@query(f"SELECT group_id, arg_min(piece_id, ({H.format(k=chr(39) + '5|' + chr(39) + ' || piece_id')}, piece_id)) AS piece_id FROM piece GROUP BY group_id")
def one_sample_per_group(s):
    return contracts.one_per_group(s.piece, ["group_id"], "piece_id", 5).select("group_id", "piece_id")


@query()
def grouped_kfold(s):
    groups = s.piece.groupBy("group_id", F.col("composer").alias("label")).agg(F.count("*").alias("n"))
    return contracts.grouped_folds(groups, folds=5, repeats=5, seed=11)


@query(
    """WITH f AS (SELECT sha256(CAST(s_nationkey AS VARCHAR)) AS sha, s_nationkey % 3 AS label FROM supplier UNION ALL SELECT sha256(CAST(c_nationkey AS VARCHAR)), c_nationkey % 2 FROM customer)
    SELECT sha, count(*) AS n, count(DISTINCT label) > 1 AS cross_class FROM f GROUP BY sha HAVING count(*) > 1"""
)
def sha_duplicates(s):
    a = s.table("supplier").select(F.sha2(F.col("s_nationkey").cast("string"), 256).alias("sha"), F.pmod("s_nationkey", F.lit(3)).alias("label"))
    b = s.table("customer").select(F.sha2(F.col("c_nationkey").cast("string"), 256).alias("sha"), F.pmod("c_nationkey", F.lit(2)).alias("label"))
    return contracts.content_duplicates(a.unionByName(b), "sha", "label")


@query(
    """WITH c AS (SELECT piece_id, count(*) AS n, count_if(velocity = 127) AS bad FROM note GROUP BY piece_id)
    SELECT composer, CASE WHEN bad > 6 THEN 'excluded' ELSE 'accepted' END AS status, count(*) AS samples, count(DISTINCT group_id) AS groups, CAST(sum(n) AS BIGINT) AS notes FROM c JOIN piece USING (piece_id) GROUP BY ALL"""
)
def quality_gate(s):
    c = s.note.groupBy("piece_id").agg(F.count("*").alias("n"), F.count_if(F.col("velocity") == 127).alias("bad"))
    status = F.when(F.col("bad") > 6, "excluded").otherwise("accepted")
    return c.join(s.piece, "piece_id").groupBy("composer", status.alias("status")).agg(F.count("*").alias("samples"), F.count_distinct("group_id").alias("groups"), F.sum("n").alias("notes"))


@query("""WITH n AS (SELECT composer, piece_id, CAST(count(*) AS DOUBLE) AS n FROM note JOIN piece USING (piece_id) GROUP BY ALL), m AS (SELECT composer, quantile_cont(n, 0.5) AS m FROM n GROUP BY composer)
    SELECT composer, arg_min(piece_id, (abs(n - m), piece_id)) AS piece_id FROM n JOIN m USING (composer) GROUP BY composer""")
def representatives(s):
    counts = s.note.join(s.piece.select("piece_id", "composer"), "piece_id").groupBy("composer", "piece_id").agg(F.count("*").alias("n"))
    return contracts.median_representatives(counts, ["composer"], "piece_id", "n")


_COUNTS = "SELECT composer, piece_id, count(*) AS n FROM note JOIN piece USING (piece_id) GROUP BY ALL"
_QUANTILES = "SELECT composer, quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.5) AS b, quantile_cont(n, 0.75) AS c FROM n GROUP BY composer"


@query(
    f"""WITH n AS ({_COUNTS}), q AS ({_QUANTILES}), x AS (SELECT composer, arg_min(piece_id, (abs(n - a), piece_id)) AS p FROM n JOIN q USING (composer) GROUP BY composer),
    y AS (SELECT composer, arg_min(piece_id, (abs(n - b), piece_id)) AS p FROM n JOIN q USING (composer) JOIN x USING (composer) WHERE piece_id <> x.p GROUP BY composer),
    z AS (SELECT composer, arg_min(piece_id, (abs(n - c), piece_id)) AS p FROM n JOIN q USING (composer) JOIN x USING (composer) JOIN y USING (composer) WHERE piece_id <> x.p AND piece_id <> y.p GROUP BY composer)
    SELECT composer, 0.25::DOUBLE AS share, p AS piece_id FROM x UNION ALL SELECT composer, 0.5, p FROM y UNION ALL SELECT composer, 0.75, p FROM z"""
)
def quantile_representatives(s):
    counts = s.note.join(s.piece.select("piece_id", "composer"), "piece_id").groupBy("composer", "piece_id").agg(F.count("*").alias("n"))
    return contracts.quantile_representatives(counts, ["composer"], "piece_id", "n", (0.25, 0.5, 0.75))


def _vectors(s):
    wide = features.composition_vector(s.note, s.meter, TPB)
    labelled = features.packed(wide, features.COMPOSITION_FEATURES).join(s.piece.select("piece_id", "composer", "fold"), "piece_id")
    return checkpoint(labelled.repartition("piece_id"))  # vectors are few bytes: as many partitions as those fill


@query()
def rf_predictions(s):
    return evaluation.fold_predictions(_vectors(s), "forest", [0, 1, 2, 3, 4], trees=20, depth=5)


@query()
def lr_predictions(s):
    return evaluation.fold_predictions(_vectors(s), "logistic", [0, 1, 2, 3, 4], c=1.0)


@query(
    """WITH c AS (SELECT f.fold, p.composer, count(*) AS n FROM (SELECT DISTINCT fold FROM piece) f JOIN piece p ON p.fold <> f.fold WHERE piece_id IN (SELECT piece_id FROM note) GROUP BY ALL)
    SELECT piece_id, fold, 'dummy' AS model, composer AS true_label, guess AS predicted_label FROM piece LEFT JOIN (SELECT fold, arg_min(composer, (-n, composer)) AS guess FROM c GROUP BY fold) g USING (fold) WHERE piece_id IN (SELECT piece_id FROM note)"""
)
def dummy_predictions(s):
    """The model asks for labels alone, so no vector is measured."""
    with_notes = s.piece.select("piece_id", "composer", "fold").join(s.note.select("piece_id").distinct(), "piece_id", "left_semi")
    samples = checkpoint(with_notes.withColumn("vector", F.array().cast("array<double>")))
    return evaluation.fold_predictions(samples, "dummy", [0, 1, 2, 3, 4])


@query()
def permutation_importance(s):
    vectors = _vectors(s)
    from pyspark.ml.functions import array_to_vector

    train = vectors.where("fold <> 0").withColumn("label", F.col("composer")).withColumn("vector", array_to_vector("vector"))
    fitted = evaluation.model("forest", 93, 0, trees=15, depth=5).fit(evaluation.balanced_weights(train, "label"))
    names = F.array(*[F.lit(x) for x in fitted.stages[0].labels])

    def scored(df):
        ready = df.withColumn("label", F.col("composer")).withColumn("vector", array_to_vector("vector")).withColumn("weight", F.lit(1.0))
        return fitted.transform(ready).withColumn("predicted_label", F.element_at(names, (F.col("prediction") + 1).cast("int")))

    return evaluation.permutation_drop(scored, vectors.where("fold = 0"), list(range(93)), repeats=3, seed=3)
