"""Open-set scenarios: models of known labels, a threshold calibrated on some
unknown ones and tested on others, for any number of scenarios in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..plans.checkpoints import checkpoint
from .openset import unknown_fold

#: Scores have so many places, so a scenario has a bounded number of different ones.
PLACES = 4


def rotations(labels: list[str]) -> list[tuple[str, str, str]]:
    """(scenario, calibration unknown, test unknown): every label in turn is the
    unknown one of the test, the label after it that of the calibration."""
    return [(f"without_{a}_and_{b}", b, a) for a, b in zip(labels, [*labels[1:], labels[0]], strict=True)]


def parts_of(samples: DataFrame, scenarios: DataFrame, folds: int, seed: int, key: str = "piece_id") -> DataFrame:
    """(scenario, fold, cell, key, label, is_train, role): who trains and who is
    scored by the model of each fold. Known samples are scored in their own
    fold, unknown ones in a fold drawn by hash; nobody is scored twice.

    ``samples``: (key, label, fold); ``scenarios``: (scenario, calibration, test).
    """
    each = samples.join(F.broadcast(scenarios))  # a row a scenario
    role = F.when(F.col("label") == F.col("calibration"), "unknown_calibration").when(F.col("label") == F.col("test"), "unknown_test").otherwise("known")
    each = each.withColumn("role", role).withColumn("own", F.when(F.col("role") == "known", F.col("fold")).otherwise(unknown_fold(seed, F.col(key), folds)))
    placed = each.drop("fold").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("is_train", (F.col("role") == "known") & (F.col("own") != F.col("fold")))
    placed = placed.where(F.col("is_train") | (F.col("own") == F.col("fold")))
    return placed.select("scenario", "fold", F.concat_ws("|", "scenario", F.col("fold").cast("string")).alias("cell"), key, "label", "is_train", "role")


def best_labels(probabilities: DataFrame, key: str = "piece_id") -> DataFrame:
    """(cell, key, predicted, score): the likeliest label and its probability."""
    p = F.round("p", PLACES)
    best = probabilities.groupBy("cell", key).agg(F.max_by(F.struct("label", p.alias("score")), F.struct(p, -F.col("label"))).alias("b"))
    return best.select("cell", key, F.col("b.label").alias("predicted"), "b.score")


def _curve(rows: DataFrame) -> DataFrame:
    """(scenario, score, pos, neg, tp, fp, all_pos, all_neg) at every distinct score, accepting it and all above."""
    counts = rows.groupBy("scenario", "score").agg(F.count_if("is_known").alias("pos"), F.count_if(~F.col("is_known")).alias("neg"))
    above = Window.partitionBy("scenario").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("scenario")
    return counts.select("*", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(every).alias("all_pos"), F.sum("neg").over(every).alias("all_neg"))


def thresholds(rows: DataFrame, target: float) -> DataFrame:
    """(scenario, threshold): of those that keep ``target`` of the known rows
    the one of the best balanced accuracy, then of the best unknown recall, then
    the highest. ``rows``: (scenario, score, is_known)."""
    c = _curve(rows).withColumn("known", ratio(F.col("tp"), F.col("all_pos"))).withColumn("unknown", 1 - ratio(F.col("fp"), F.col("all_neg")))
    order = F.struct(F.round((F.col("known") + F.col("unknown")) / 2, 12), F.round("unknown", 12), "score")
    return c.where(F.col("known") + 1e-12 >= target).groupBy("scenario").agg(F.max_by("score", order).alias("threshold"))


def scenario_metrics(rows: DataFrame, limits: DataFrame, target: float) -> DataFrame:
    """By scenario, counts and ranking metrics of ``rows`` (scenario, score,
    is_known, true_label, predicted) and what the threshold does to them."""
    c = _curve(rows)
    below = F.col("all_neg") - F.col("fp") + F.col("neg") / 2
    ranking = c.groupBy("scenario").agg(
        F.max("all_pos").alias("n_known"), F.max("all_neg").alias("n_unknown"),
        ratio(F.sum(F.col("pos") * below), F.max(F.col("all_pos") * F.col("all_neg"))).alias("auroc"),
        F.sum(ratio(F.col("pos"), F.col("all_pos")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("auprc"),
        F.coalesce(F.min(F.when(ratio(F.col("tp"), F.col("all_pos")) >= target, ratio(F.col("fp"), F.col("all_neg")))), F.lit(1.0)).alias("fpr_at_tpr"),
    )
    judged = rows.join(limits, "scenario").withColumn("accepted", F.col("score") >= F.col("threshold"))
    share = lambda when, p: F.avg(F.when(when, p.cast("double")))
    at = judged.groupBy("scenario").agg(
        F.max("threshold").alias("threshold"), share(F.col("is_known"), F.col("accepted")).alias("known_recall"), share(~F.col("is_known"), ~F.col("accepted")).alias("unknown_recall"), share(F.lit(True), F.col("accepted")).alias("coverage")
    )
    right = judged.where("is_known AND accepted").groupBy("scenario", "true_label").agg(F.avg((F.col("true_label") == F.col("predicted")).cast("double")).alias("recall"))
    # Recall over all known labels; those of which nothing is accepted count 0.
    kinds = judged.where("is_known").groupBy("scenario").agg(F.count_distinct("true_label").alias("kinds"))
    accepted = kinds.join(right.groupBy("scenario").agg(F.sum("recall").alias("sum")), "scenario", "left").select("scenario", (F.coalesce("sum", F.lit(0.0)) / F.col("kinds")).alias("accepted_balanced_accuracy"))
    return ranking.join(at, "scenario").join(accepted, "scenario")


def open_scenarios(vectors: DataFrame, samples: DataFrame, scenarios: list[tuple[str, str, str]], folds: int, calibration_folds: list[int], target: float = 0.95, c: float = 1.0, seed: int = 1729, key: str = "piece_id") -> tuple[DataFrame, DataFrame]:
    """(metrics, scored rows) of all scenarios with logistic regressions, fitted
    together. ``vectors``: (key, vector); ``samples``: (key, label, fold)."""
    from .logistic import fit_logistic, predict_logistic

    spark = vectors.sparkSession
    names = [r.label for r in samples.select("label").distinct().sort("label").collect()]  # labels, not rows
    plan = spark.createDataFrame(scenarios, "scenario string, calibration string, test string")
    parts = checkpoint(parts_of(samples, plan, folds, seed, key))
    index = F.array_position(F.array(*map(F.lit, names)), F.col("label")).cast("int") - 1
    rows = parts.join(vectors.select(key, F.col("vector").alias("x")), key)
    fits = fit_logistic(rows.where("is_train").select("cell", key, index.alias("label"), "x"), parts.select("cell", F.lit(c).alias("c")).distinct(), len(names), key)
    tested = parts.where("NOT is_train")
    best = best_labels(predict_logistic(rows.where("NOT is_train"), fits, key), key)
    named = F.element_at(F.array(*map(F.lit, names)), F.col("predicted") + 1)
    scored = checkpoint(best.join(tested, ["cell", key]).select("scenario", "fold", key, "role", F.col("label").alias("true_label"), named.alias("predicted"), "score", (F.col("role") == "known").alias("is_known")))
    calibration = scored.where((F.col("is_known") & F.col("fold").isin(calibration_folds)) | (F.col("role") == "unknown_calibration"))
    test = scored.where((F.col("is_known") & ~F.col("fold").isin(calibration_folds)) | (F.col("role") == "unknown_test"))
    return scenario_metrics(test, checkpoint(thresholds(calibration, target)), target), scored
