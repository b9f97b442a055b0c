"""Open-set recognition: thresholds, ranking metrics, unknown folds.

Scores are summed per distinct value first; the cumulative windows run over
distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_ordinal, ratio


def unknown_fold(seed: int, key: Column, folds: int) -> Column:
    return hash_ordinal(F.lit(folds), F.lit(seed), key)


def mean_scores(scores: DataFrame, key: str) -> DataFrame:
    """(key, label, probability, is_best): mean over models, argmax by label."""
    means = scores.groupBy(key, "label").agg(F.avg("probability").alias("probability"))
    order = Window.partitionBy(key).orderBy(F.col("probability").desc(), "label")
    return means.withColumn("is_best", F.row_number().over(order) == 1)


def score_counts(scores: DataFrame) -> DataFrame:
    """(score, pos, neg) per distinct score. ``scores``: (score, is_known)."""
    return scores.groupBy("score").agg(F.count_if("is_known").alias("pos"), F.count_if(~F.col("is_known")).alias("neg"))


def running_sums(df: DataFrame, order: str, values: list[str], ascending: bool = True, stretches: int = 64) -> DataFrame:
    """Adds ``<value>_upto`` per value: its sum over rows up to and with this
    one by ``order``, whose values are distinct.

    The order is cut into stretches at approximate quantiles; sums within a
    stretch add to the sums of the stretches before, so no task sees all rows.
    """
    cuts = sorted(set(df.approxQuantile(order, [i / stretches for i in range(1, stretches)], 0.002)))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    placed = df.withColumn("_at", at)
    way = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    before = Window.orderBy(way("_at")).rowsBetween(Window.unboundedPreceding, -1)  # over the stretches
    ahead = placed.groupBy("_at").agg(*[F.sum(v).alias(v) for v in values]).select("_at", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values])
    within = Window.partitionBy("_at").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    met = placed.join(F.broadcast(ahead), "_at")
    return met.select(*df.columns, *[(F.sum(v).over(within) + F.col(f"_{v}")).alias(f"{v}_upto") for v in values])


def curve(scores: DataFrame) -> DataFrame:
    """(score, tp, fp, pos, neg, tpr, fpr, precision): accepting each distinct
    score and all above it."""
    counts = score_counts(scores)
    sums = running_sums(counts, "score", ["pos", "neg"], ascending=False).join(F.broadcast(counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))))
    c = sums.select("score", F.col("pos_upto").alias("tp"), F.col("neg_upto").alias("fp"), F.col("p").alias("pos"), F.col("n").alias("neg"), F.col("pos").alias("here"))
    return c.withColumns({"tpr": ratio(F.col("tp"), F.col("pos")), "fpr": ratio(F.col("fp"), F.col("neg")), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"))})


def auroc(scores: DataFrame) -> DataFrame:
    """(auroc): rank sum with average ranks of ties."""
    c = running_sums(score_counts(scores), "score", ["neg"])
    sums = c.agg(F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(ratio(F.col("u"), F.col("p") * F.col("n")).alias("auroc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """(auprc): precision summed over steps of recall."""
    return curve(scores).agg(F.sum(ratio(F.col("here"), F.col("pos")) * F.col("precision")).alias("auprc"))


def fpr_at_tpr(scores: DataFrame, tpr: float) -> DataFrame:
    return curve(scores).where(F.col("tpr") >= tpr).agg(F.min("fpr").alias("fpr"))


def choose_threshold(scores: DataFrame, known_recall: float) -> DataFrame:
    """(threshold, known_recall, unknown_recall, balanced_accuracy): of the
    thresholds that keep enough known rows the one of the best balanced
    accuracy, then of the best unknown recall, then the highest."""
    c = curve(scores).select("score", F.col("tpr").alias("known_recall"), (1 - F.col("fpr")).alias("unknown_recall")).where(F.col("known_recall") >= known_recall)
    c = c.withColumn("balanced_accuracy", (F.col("known_recall") + F.col("unknown_recall")) / 2)
    best = F.max(F.struct(F.round("balanced_accuracy", 12).alias("b"), F.round("unknown_recall", 12).alias("u"), F.col("score"), "known_recall", "unknown_recall", "balanced_accuracy"))
    return c.agg(best.alias("x")).select(F.col("x.score").alias("threshold"), "x.known_recall", "x.unknown_recall", "x.balanced_accuracy")


def open_predictions(rows: DataFrame, threshold: Column | float) -> DataFrame:
    """Adds accepted and open_prediction: ``unknown`` below the threshold."""
    accepted = F.col("score") >= threshold
    return rows.withColumn("accepted", accepted).withColumn("open_prediction", F.when(accepted, F.col("predicted_label")).otherwise("unknown"))


def open_metrics(rows: DataFrame) -> DataFrame:
    """(known_recall, unknown_recall, coverage, accepted_accuracy)."""
    known, accepted = F.col("is_known"), F.col("accepted")
    right = (F.col("predicted_label") == F.col("true_label")).cast("double")
    return rows.agg(
        F.avg(F.when(known, accepted.cast("double"))).alias("known_recall"), F.avg(F.when(~known, (~accepted).cast("double"))).alias("unknown_recall"),
        F.avg(accepted.cast("double")).alias("coverage"), F.avg(F.when(known & accepted, right)).alias("accepted_accuracy"),
    )


def open_confusion(rows: DataFrame) -> DataFrame:
    label = F.when(F.col("is_known"), F.col("true_label")).otherwise("unknown")
    return rows.groupBy(label.alias("true_label"), "open_prediction").agg(F.count("*").alias("n"))
