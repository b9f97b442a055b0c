"""Task matrices, resumption, histories of searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_ordinal, task_id


def task_matrix(sources: DataFrame, labels: DataFrame, phase: str, repeat: int = 0) -> DataFrame:
    """Every source with every other label: (phase, repeat, fold, source_id,
    source_label, target_label, task_id, signature). The labels are a short
    list and are dealt out as an array, so no product of tables is planned."""
    every = labels.agg(F.array_sort(F.collect_set("label")).alias("labels"))
    rows = sources.join(F.broadcast(every)).withColumn("target_label", F.explode("labels")).where(F.col("target_label") != F.col("source_label"))
    ids = task_id(F.lit(phase), F.lit(repeat), F.col("fold"), F.col("source_id"), F.col("target_label"))
    rows = rows.select(F.lit(phase).alias("phase"), F.lit(repeat).alias("repeat"), "fold", "source_id", "source_label", "target_label", ids.alias("task_id"))
    return rows.withColumn("signature", signature("phase", "repeat", "fold", "source_id", "source_label", "target_label"))


def signature(*fields: str) -> Column:
    """sha256 of the fields as JSON in the given order."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def completed(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks whose result is finished and carries the same signature."""
    done = results.where("status = 'completed'").select("task_id", "signature").distinct()
    return tasks.join(done, ["task_id", "signature"], "left_semi")


def pending(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """What is still to do: resumption is an anti join."""
    done = results.where("status = 'completed'").select("task_id", "signature").distinct()
    return tasks.join(done, ["task_id", "signature"], "left_anti")


def task_status(tasks: DataFrame, results: DataFrame) -> DataFrame:
    met = tasks.join(results.select("task_id", "status"), "task_id", "left")
    return met.groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count("*").alias("n"))


def matrix_problems(tasks: DataFrame, targets_per_source: int) -> DataFrame:
    """(source_id, problem) where the matrix breaks its contract."""
    each = tasks.groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("target_label").alias("targets"), F.count_distinct("task_id").alias("ids"), F.bool_or(F.col("target_label") == F.col("source_label")).alias("own"))
    problem = F.when(F.col("own"), "targets itself").when(F.col("targets") != targets_per_source, "targets").when(F.col("ids") != F.col("n"), "ids")
    return each.select("source_id", problem.alias("problem")).where("problem IS NOT NULL")


def paired(first: DataFrame, second: DataFrame, on: list[str], value: str) -> DataFrame:
    """(on, first, second, difference): second minus first."""
    a, b = first.select(*on, F.col(value).alias("first")), second.select(*on, F.col(value).alias("second"))
    return a.join(b, on).withColumn("difference", F.col("second") - F.col("first"))


def running_best(history: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adds best_so_far, and stagnation: generations since it last rose."""
    w = Window.partitionBy(*by).orderBy(order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    marked = history.withColumn("best_so_far", F.max(value).over(upto)).withColumn("_rose", F.col(value) > F.coalesce(F.max(value).over(before), F.lit(float("-inf"))) + 1e-12)
    spell = marked.withColumn("_spell", F.sum(F.col("_rose").cast("int")).over(upto))
    return spell.withColumn("stagnation", (F.row_number().over(Window.partitionBy(*by, "_spell").orderBy(order)) - 1).cast("long")).drop("_rose", "_spell")


def elites(population: DataFrame, by: list[str], fitness: str, index: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(fitness).desc(), index)
    return population.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tournament(population: DataFrame, by: list[str], index: str, fitness: str, rounds: int, size: int, seed: int) -> DataFrame:
    """(by, round, winner): ``size`` draws with replacement, the fittest wins,
    the earliest draw if several are. ``index`` numbers 0 to n - 1."""
    counts = population.groupBy(*by).agg(F.count("*").alias("n"))
    plan = F.explode(F.array(*[F.struct(F.lit(r).alias("round"), F.lit(d).alias("draw")) for r in range(rounds) for d in range(size)]))
    drawn = counts.select(*by, "n", plan.alias("p")).select(*by, "n", "p.*")
    drawn = drawn.withColumn(index, hash_ordinal(F.col("n"), F.lit(seed), *[F.col(b) for b in by], F.col("round"), F.col("draw")))
    met = drawn.join(population.select(*by, F.col(index).cast("long").alias(index), fitness), [*by, index])
    return met.groupBy(*by, "round").agg(F.min_by(index, F.struct(-F.col(fitness), "draw")).alias("winner"))


def ranking_key(feasible: Column, gain: Column, violation: Column) -> Column:
    """Feasible first by gain, then by the least violation: compare as a struct."""
    return F.struct(feasible.cast("int").alias("feasible"), F.when(feasible, gain).otherwise(-violation).alias("value"))


def random_other_label(index: Column, n: int, seed: int, *key: Column) -> Column:
    """A label index other than the row's own, uniform over the rest."""
    return F.pmod(index + 1 + hash_ordinal(F.lit(n - 1), F.lit(seed), *key), F.lit(n))


def balanced_draws(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """(position, label, key): every label drawn with replacement as often as
    the largest one has rows, labels interleaved."""
    placed = rows.withColumn("at", (F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1).cast("long"))
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    order = counts.withColumn("li", F.row_number().over(Window.orderBy(label)) - 1).withColumn("labels", F.count("*").over(Window.partitionBy(F.lit(0)))).withColumn("most", F.max("n").over(Window.partitionBy(F.lit(0))))
    draws = order.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - 1)))
    draws = draws.select(label, (F.col("draw") * F.col("labels") + F.col("li")).alias("position"), hash_ordinal(F.col("n"), F.lit(seed), F.col(label), F.col("draw")).alias("at"))
    return draws.join(placed.select(label, "at", key), [label, "at"]).select("position", label, key)


def per_label_first(rows: DataFrame, by: list[str], key: str, n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(key))).where(F.col("_r") <= n).drop("_r")
