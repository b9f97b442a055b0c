"""Classification: centroid and pyspark.ml models, out-of-fold metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_bits, r6, ratio


def centroid_predictions(long: DataFrame, samples: DataFrame, key: str = "piece_id", label: str = "composer", by: list[str] | None = None) -> DataFrame:
    """(by, key, fold, true_label, predicted_label, distance): nearest class
    mean, means over the other folds only.

    Means of all folds but one come from sums per (fold, label), so the data
    are aggregated once. ``long``: (key, idx, value); ``samples`` may have
    several labellings, told apart by ``by``.
    """
    by = by or []
    cells = long.join(samples.select(*by, key, label, "fold"), key)
    sums = cells.groupBy(*by, "fold", label, "idx").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    total = sums.groupBy(*by, label, "idx").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    folds = samples.select("fold").distinct()
    means = total.join(F.broadcast(folds)).join(sums, [*by, "fold", label, "idx"], "left")  # a few folds
    means = means.select(*by, "fold", F.col(label).alias("_label"), "idx", F.try_divide(F.col("ts") - F.coalesce("s", F.lit(0.0)), F.col("tn") - F.coalesce("n", F.lit(0))).alias("mean"))
    d = F.col("value") - F.col("mean")
    scored = cells.join(means.where("mean IS NOT NULL"), [*by, "fold", "idx"]).groupBy(*by, key, "fold", label, "_label").agg(F.sqrt(F.sum(d * d)).alias("d"))
    best = F.min(F.struct(r6(F.col("d")).alias("d"), F.col("_label")))
    return scored.groupBy(*by, key, "fold", F.col(label).alias("true_label")).agg(best.alias("b")).select(*by, key, "fold", "true_label", F.col("b._label").alias("predicted_label"), F.col("b.d").alias("distance"))


def retrained_permutation(long: DataFrame, samples: DataFrame, permutations: int, seed: int, key: str = "piece_id", label: str = "composer") -> DataFrame:
    """(draw, accuracy) of the centroid model trained and tested anew on labels
    that are dealt among whole groups; draw 0 has the true labels.
    ``samples``: (key, group_id, label, fold). All draws run in one plan."""
    groups = samples.select("group_id", label).distinct()
    each = groups.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    w = Window.partitionBy("draw")
    chance = F.when(F.col("draw") == 0, F.col("group_id").cast("decimal(20,0)")).otherwise(hash_bits(F.lit(seed), F.col("draw"), F.col("group_id")))
    own = each.select("draw", "group_id", F.row_number().over(w.orderBy("group_id")).alias("_at"))
    dealt = each.select("draw", label, F.row_number().over(w.orderBy(chance, "group_id")).alias("_at"))
    anew = own.join(dealt, ["draw", "_at"]).join(samples.select(key, "group_id", "fold"), "group_id")
    found = centroid_predictions(long, anew, key, label, ["draw"])
    return found.groupBy("draw").agg(F.avg((F.col("true_label") == F.col("predicted_label")).cast("double")).alias("accuracy"))


def permutation_p(draws: DataFrame) -> DataFrame:
    """(observed, p) from (draw, accuracy) with the truth as draw 0."""
    sums = draws.agg(F.max(F.when(F.col("draw") == 0, F.col("accuracy"))).alias("observed"), F.sort_array(F.collect_list(F.when(F.col("draw") > 0, F.col("accuracy")))).alias("_all"))
    k = F.size(F.filter("_all", lambda x: x >= F.col("observed") - 1e-12))
    return sums.select("observed", ((k + 1) / (F.size("_all") + 1)).alias("p"))


def confusion(predictions: DataFrame, by: list[str]) -> DataFrame:
    return predictions.groupBy(*by, "true_label", "predicted_label").agg(F.count("*").alias("n"))


def class_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, support, recall, precision, f1); 0 where undefined."""
    cells = confusion(predictions, by)
    hit = F.col("true_label") == F.col("predicted_label")
    as_true = cells.groupBy(*by, F.col("true_label").alias("label")).agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("tp"))
    as_pred = cells.groupBy(*by, F.col("predicted_label").alias("label")).agg(F.sum("n").alias("claimed"))
    both = as_true.join(as_pred, [*by, "label"], "full_outer").na.fill(0)
    return both.select(
        *by, "label", "support", ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(F.col("tp"), F.col("claimed")).alias("precision"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("claimed")).alias("f1"),
    )


def summary_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, balanced_accuracy, macro_f1) over the labels that occur as true."""
    each = class_metrics(predictions, by).where("support > 0")
    return each.groupBy(*by).agg(F.sum("support").alias("n"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))


def oof_grouping_sets(predictions: DataFrame, outer: list[str], inner: str) -> DataFrame:
    """(outer, inner or null for all, n, correct, accuracy) in one pass."""
    hit = (F.col("true_label") == F.col("predicted_label")).cast("long")
    sets = [[*map(F.col, outer)], [*map(F.col, [*outer, inner])]]
    return predictions.groupingSets(sets, *outer, inner).agg(F.count("*").alias("n"), F.sum(hit).alias("correct")).withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def form_accuracy(predictions: DataFrame, form: str) -> DataFrame:
    hit = (F.col("true_label") == F.col("predicted_label")).cast("double")
    return predictions.groupBy(form).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def misclassified(predictions: DataFrame, key: str) -> DataFrame:
    """(key, errors, rank): samples by how often they were mistaken."""
    wrong = predictions.where("true_label <> predicted_label").groupBy(key).agg(F.count("*").alias("errors"))
    return wrong.withColumn("rank", F.row_number().over(Window.orderBy(F.col("errors").desc(), key)))


def aligned_probabilities(scores: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Every (key, label) with its probability, 0 where a model has no such label."""
    return scores.select(*keys).distinct().join(F.broadcast(labels)).join(scores, [*keys, "label"], "left").na.fill(0.0, ["probability"])


def model(name: str, n_features: int, n_train: int, c: float = 1.0, trees: int = 60, depth: int = 8, seed: int = 7):
    """A pyspark.ml pipeline: variance filter, then logistic regression on
    standardised features, or a random forest; balanced by class weights."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, StringIndexer, VarianceThresholdSelector

    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep")
    keep = VarianceThresholdSelector(featuresCol="vector", outputCol="kept", varianceThreshold=0.0)
    if name == "logistic":
        scale = StandardScaler(inputCol="kept", outputCol="scaled", withMean=True)
        fit = LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="weight", regParam=1.0 / (c * max(n_train, 1)), maxIter=100, standardization=False)
        return Pipeline(stages=[index, keep, scale, fit])
    if name == "forest":
        fit = RandomForestClassifier(featuresCol="kept", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
        return Pipeline(stages=[index, keep, fit])
    raise ValueError(f"no model {name!r}")


def balanced_weights(train: DataFrame, label: str) -> DataFrame:
    """Adds weight: n / (classes * n of the class)."""
    counts = train.groupBy(label).agg(F.count("*").alias("_n"))
    sums = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return train.join(F.broadcast(counts.join(F.broadcast(sums))), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def fold_predictions(vectors: DataFrame, name: str, folds: list[int], key: str = "piece_id", label: str = "composer", **settings) -> DataFrame:
    """(key, fold, model, true_label, predicted_label): each fold is predicted by
    a model of the other folds. ``vectors``: (key, label, fold, vector array).
    Folds are few; each is one distributed fit."""
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(key, F.col(label).alias("label"), "fold", array_to_vector("vector").alias("vector"))
    found = None
    for fold in folds:
        train, test = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        if name == "dummy":
            from .profiles import most_frequent

            common = most_frequent(train, "label", []).first()
            scored = test.withColumn("predicted_label", F.lit(common[0] if common else None))
        else:
            fitted = model(name, 0, train.count(), **settings).fit(balanced_weights(train, "label"))
            names = F.array(*[F.lit(x) for x in fitted.stages[0].labels])
            scored = fitted.transform(test.withColumn("weight", F.lit(1.0))).withColumn("predicted_label", F.element_at(names, (F.col("prediction") + 1).cast("int")))
        part = scored.select(key, "fold", F.lit(name).alias("model"), F.col("label").alias("true_label"), "predicted_label")
        found = part if found is None else found.unionByName(part)
    return found


def permutation_drop(scored, vectors: DataFrame, features: list[int], repeats: int, seed: int, label: str = "composer") -> DataFrame:
    """(feature, mean_drop, std_drop) of accuracy when a feature's values are
    dealt among the rows anew. ``scored`` turns a DataFrame with ``vector`` into
    one with predicted_label; all shuffles are scored in one pass."""
    plan = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("again")) for f in features for r in range(repeats)]))
    # Only single values are dealt; a row meets all of its new ones at once, so no vector is copied before it is scored.
    cells = vectors.select("piece_id", plan.alias("p"), "vector").select("piece_id", "p.*", F.element_at("vector", F.col("p.feature") + 1).alias("_new"))
    key = Window.partitionBy("feature", "again")
    own = cells.select("piece_id", "feature", "again", F.row_number().over(key.orderBy("piece_id")).alias("_at"))
    dealt = cells.select("feature", "again", F.row_number().over(key.orderBy(hash_bits(F.lit(seed), F.col("feature"), F.col("again"), F.col("piece_id")))).alias("_at"), "_new")
    new = own.join(dealt, ["feature", "again", "_at"]).groupBy("piece_id").agg(F.collect_list(F.struct("feature", "again", "_new")).alias("p"))
    swapped = vectors.join(new, "piece_id").withColumn("p", F.explode("p")).select("*", "p.*").drop("p")
    swapped = swapped.withColumn("vector", F.transform("vector", lambda x, i: F.when(i == F.col("feature"), F.col("_new")).otherwise(x)))
    base = scored(vectors).agg(F.avg((F.col("predicted_label") == F.col(label)).cast("double")).alias("base"))
    each = scored(swapped).groupBy("feature", "again").agg(F.avg((F.col("predicted_label") == F.col(label)).cast("double")).alias("acc"))
    drops = each.join(F.broadcast(base)).withColumn("drop", F.col("base") - F.col("acc"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("mean_drop"), F.stddev_pop("drop").alias("std_drop"))


def share_of(p: Column) -> Column:
    return F.avg(p.cast("double"))
