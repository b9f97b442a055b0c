"""Roles, work groups, choices for reports, nested validation, open rotations."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import r6, ratio
from .digests import list_digests, set_digests


def _ascii(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def ascii_slug(text: Column) -> Column:
    """Lower-case ASCII words joined by ``-``: compatibility forms are taken
    apart, and what is not ASCII then goes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.pandas_udf(_ascii, "string")(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


# How works are numbered in titles, by composer.
WORKS = (
    ("Bach", r"(?i)(?:Prelude|Fugue)_bwv_(\d+)", "bwv-"),
    ("Beethoven", r"(?i)^Piano_Sonatas_(\d+)(?:-|$)", "piano-sonata-"),
    ("Chopin", r"(?i)^Sonata_(\d+)(?:_|$)", "sonata-"),
)
OTHER_WORK = (r"(?i)^(?:Piano|Keyboard)_Sonatas_(\d+)(?:-|$)", "keyboard-sonata-")


def work_group(composer: Column, title: Column) -> Column:
    """``composer--work``: movements of one work are one group."""
    def numbered(pattern: str, prefix: str) -> Column:
        number = F.regexp_extract(title, pattern, 1)
        return F.when(number != "", F.concat(F.lit(prefix), number))

    found = numbered(*OTHER_WORK)
    for name, pattern, prefix in reversed(WORKS):
        found = F.when(composer == name, numbered(pattern, prefix)).otherwise(found)
    return F.concat(ascii_slug(composer), F.lit("--"), F.coalesce(found, ascii_slug(title)))


def open_roles(rows: DataFrame, label: str, known: list[str], calibration: list[str], test: list[str]) -> DataFrame:
    """Adds open_role; rows of other labels go."""
    role = F.when(F.col(label).isin(known), "known").when(F.col(label).isin(calibration), "unknown_calibration").when(F.col(label).isin(test), "unknown_test")
    return rows.withColumn("open_role", role).where("open_role IS NOT NULL")


#: Of the 42 features, those that a performance changes: tempo and its seconds.
PERFORMANCE_FEATURES = (0, 38, 39, 40)


def score_only(long: DataFrame) -> DataFrame:
    """The score-only variant of the long 42-feature vectors."""
    return long.where(~F.col("idx").isin(*PERFORMANCE_FEATURES))


def best_summary(summaries: DataFrame) -> DataFrame:
    """The full variant's model of the best balanced accuracy, dummies aside;
    the first by name of equals."""
    real = summaries.where("variant = 'full' AND model <> 'dummy'")
    return real.orderBy(F.col("balanced_accuracy").desc(), "model").limit(1)


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.col("mean").desc(), "feature").limit(n)


def listening_set(pairs: DataFrame, n: int, order: list[str], least: int = 10) -> DataFrame:
    """The first ``n`` pairs, numbered; never fewer than ``least`` are asked for."""
    first = pairs.orderBy(*order).limit(max(n, least))
    return first.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def selection_key(records: DataFrame, by: list[str]) -> DataFrame:
    """(by, key): valid outputs, content, few fallbacks, diversity, style gain;
    keys compare field by field."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    fields = F.struct(share("valid").alias("valid"), F.avg("content").alias("content"), (-share("fallback")).alias("fallback"), (F.count_distinct("output") / F.count("*")).alias("diversity"), F.avg("style_gain").alias("style"))
    return records.groupBy(*by).agg(fields.alias("key"))


def relative_path(path: Column, root: str) -> Column:
    """The path below a root; the path itself elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path)


def distance_problems(pairs: DataFrame) -> DataFrame:
    """Adds problem for vectors ``a`` and ``b`` that have no distance."""
    bad = lambda c: F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = F.when((F.size("a") < 1) | (F.size("b") < 1), "empty").when(F.size("a") != F.size("b"), "length").when(bad("a") | bad("b"), "not finite")
    return pairs.withColumn("problem", problem)


def unknown_targets(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Asked target labels that the metadata don't have."""
    return asked.join(known, "label", "left_anti")


def split_partitions(members: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, n, ids): how many, and an order-free digest of the ids in place of the list."""
    return set_digests(members, by, key).withColumnRenamed("digest", "ids")


def nested_centroid(long: DataFrame, samples: DataFrame, variants: DataFrame, repeat: str = "repeat", key: str = "piece_id", label: str = "composer") -> DataFrame:
    """(variant, repeat, fold, key, true_label, predicted_label, param):
    out-of-fold predictions of the class-mean model whose metric, of order 1 or
    2, is chosen by balanced accuracy over inner folds of the training part.

    ``samples``: (key, repeat, fold, label); ``variants``: (variant, idx). For
    an outer fold and a fold held out inside it, class means are totals less
    the sums of both, so the data are aggregated once for all of them.
    """
    at = ["variant", repeat]
    cells = long.join(F.broadcast(variants), "idx").join(samples.select(key, repeat, "fold", label), key)
    sums = cells.groupBy(*at, "fold", label, "idx").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    total = sums.groupBy(*at, label, "idx").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    folds = samples.select(repeat, F.col("fold").alias("outer")).distinct()  # a few
    pairs = F.broadcast(folds.join(folds.withColumnRenamed("outer", "held"), repeat))
    less = lambda name: sums.select(*at, F.col("fold").alias(name), label, "idx", F.col("s").alias(f"s_{name}"), F.col("n").alias(f"n_{name}"))
    met = total.join(pairs, repeat).join(less("outer"), [*at, "outer", label, "idx"], "left").join(less("held"), [*at, "held", label, "idx"], "left")
    both = F.col("outer") != F.col("held")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    mean = F.try_divide(F.col("ts") - zero("s_outer") - F.when(both, zero("s_held")).otherwise(0), F.col("tn") - zero("n_outer") - F.when(both, zero("n_held")).otherwise(0))
    means = met.select(*at, "outer", F.col("held").alias("fold"), F.col(label).alias("guess"), "idx", mean.alias("mean")).where("mean IS NOT NULL")
    gap = F.abs(F.col("value") - F.col("mean"))
    scored = cells.join(means, [*at, "fold", "idx"]).groupBy(*at, "outer", "fold", key, F.col(label).alias("true_label"), "guess").agg(r6(F.sum(gap)).alias("d1"), r6(F.sqrt(F.sum(gap * gap))).alias("d2"))
    every = scored.groupBy(*at, "outer", "fold", key, "true_label").agg(*(F.min(F.struct(f"d{p}", "guess"))["guess"].alias(f"g{p}") for p in (1, 2)))
    found = every.select(*at, "outer", "fold", key, "true_label", F.explode(F.array(*(F.struct(F.lit(p).alias("param"), F.col(f"g{p}").alias("predicted_label")) for p in (1, 2)))).alias("x")).select(*at, "outer", "fold", key, "true_label", "x.*")
    recall = found.where("fold <> outer").groupBy(*at, "outer", "fold", "param", "true_label").agg(F.avg((F.col("true_label") == F.col("predicted_label")).cast("double")).alias("recall"))
    inner = recall.groupBy(*at, "outer", "fold", "param").agg(F.avg("recall").alias("ba")).groupBy(*at, "outer", "param").agg(F.round(F.avg("ba"), 9).alias("score"))
    chosen = inner.groupBy(*at, "outer").agg(F.max(F.struct("score", -F.col("param")))["col2"].alias("p")).select(*at, "outer", (-F.col("p")).alias("param"))
    out = found.where("fold = outer").join(chosen, [*at, "outer", "param"])
    return out.select(*at, "fold", key, "true_label", "predicted_label", "param")


def open_rotations(distances: DataFrame, calibration: list[int], known_recall: float, key: str = "piece_id") -> DataFrame:
    """(unknown, threshold, known_recall, unknown_recall, coverage): each label
    in turn is the unknown one. ``distances``: (key, fold, true_label, guess, d)
    to the class means of the other folds. Scores have four places, so a
    rotation has ten thousand of them at most, and its windows are bounded.
    """
    labels = distances.select(F.col("guess").alias("unknown")).distinct()
    rows = distances.join(F.broadcast(labels)).where("guess <> unknown")  # a short list
    best = rows.groupBy("unknown", key, "fold", "true_label").agg(F.min(F.struct("d", "guess")).alias("b"))
    scored = best.select("unknown", "fold", F.round(1 / (1 + F.col("b.d")), 4).alias("score"), (F.col("true_label") != F.col("unknown")).alias("is_known"))
    counts = scored.where(F.col("fold").isin(*calibration)).groupBy("unknown", "score").agg(F.count_if("is_known").alias("pos"), F.count_if(~F.col("is_known")).alias("neg"))
    down = Window.partitionBy("unknown").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("unknown")
    c = counts.select("unknown", "score", ratio(F.sum("pos").over(down), F.sum("pos").over(every)).alias("tpr"), ratio(F.sum("neg").over(down), F.sum("neg").over(every)).alias("fpr")).where(F.col("tpr") >= known_recall)
    at = c.groupBy("unknown").agg(F.max(F.struct(F.round((F.col("tpr") + 1 - F.col("fpr")) / 2, 12).alias("b"), F.round(1 - F.col("fpr"), 12).alias("u"), "score"))["score"].alias("threshold"))
    tested = scored.where(~F.col("fold").isin(*calibration)).join(F.broadcast(at), "unknown").withColumn("accepted", F.col("score") >= F.col("threshold"))
    share = lambda p, of: F.avg(F.when(of, p.cast("double")))
    return tested.groupBy("unknown", "threshold").agg(
        share(F.col("accepted"), F.col("is_known")).alias("known_recall"), share(~F.col("accepted"), ~F.col("is_known")).alias("unknown_recall"), F.avg(F.col("accepted").cast("double")).alias("coverage")
    )


def label_distances(long: DataFrame, samples: DataFrame, key: str = "piece_id", label: str = "composer") -> DataFrame:
    """(key, fold, true_label, guess, d): distances to the class means of the
    other folds, from sums by fold and label."""
    cells = long.join(samples.select(key, label, "fold"), key)
    sums = cells.groupBy("fold", label, "idx").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    total = sums.groupBy(label, "idx").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    means = total.join(F.broadcast(samples.select("fold").distinct())).join(sums, ["fold", label, "idx"], "left")
    means = means.select("fold", F.col(label).alias("guess"), "idx", F.try_divide(F.col("ts") - F.coalesce("s", F.lit(0.0)), F.col("tn") - F.coalesce("n", F.lit(0))).alias("mean")).where("mean IS NOT NULL")
    gap = F.col("value") - F.col("mean")
    return cells.join(means, ["fold", "idx"]).groupBy(key, "fold", F.col(label).alias("true_label"), "guess").agg(r6(F.sqrt(F.sum(gap * gap))).alias("d"))


def train_profiles(long: DataFrame, samples: DataFrame, key: str = "piece_id", label: str = "composer") -> DataFrame:
    """(fold, label, idx, mean, std, n, fingerprint): profiles of each label's
    samples outside each fold, with the hash of their sorted ids. From sums by fold."""
    from .profiles import guarded

    cells = long.join(samples.select(key, label, "fold"), key)
    folds = F.broadcast(samples.select(F.col("fold").alias("held")).distinct())
    sums = cells.groupBy("fold", label, "idx").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count("*").alias("n"))
    left = sums.join(folds).where("fold <> held").groupBy("held", label, "idx").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    ids = list_digests(samples.join(folds).where("fold <> held"), ["held", label], key).withColumnRenamed("digest", "fingerprint")
    return left.join(ids, ["held", label]).select(F.col("held").alias("fold"), label, "idx", mean.alias("mean"), guarded(spread).alias("std"), "n", "fingerprint")


def permutation_of_best(summaries: DataFrame, tests: DataFrame) -> DataFrame:
    """(model, p) of the best summary's model; no row where it was not tested."""
    return best_summary(summaries).join(tests, "model").select("model", "p").limit(1)


def ablation_order(summaries: DataFrame) -> DataFrame:
    """(variant, mean, spread, position): variants by their mean balanced
    accuracy over repeats, the best first. One row per variant is ordered."""
    means = summaries.groupBy("variant").agg(F.round(F.avg("balanced_accuracy"), 9).alias("mean"), F.stddev_pop("balanced_accuracy").alias("spread"))
    return means.withColumn("position", F.row_number().over(Window.orderBy(F.col("mean").desc(), "variant")))


def external_rows(summaries: DataFrame, fields: list[str]) -> DataFrame:
    """(model, line): the report's rows of the external scenario only."""
    cells = [F.coalesce(F.round(c, 3).cast("decimal(9,3)").cast("string"), F.lit("-")) for c in fields]
    return summaries.where("scenario = 'external'").select("model", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("model"), *cells), F.lit(" |")).alias("line"))
