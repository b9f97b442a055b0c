"""Splits, leakage checks and table contracts; violations come back as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_bits
from ..plans.checkpoints import checkpoint
from .order import exact_median, exact_quantiles


def leakage(train: DataFrame, test: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """(by, field, value) found on both sides, for each of several fields."""
    def cells(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
        return df.select(*by, F.explode(pairs).alias("c")).select(*by, "c.*").where("value IS NOT NULL").distinct()

    return cells(train).join(cells(test), [*by, "field", "value"], "left_semi")


def group_crossings(members: DataFrame, group: str, split: str, by: list[str] | None = None) -> DataFrame:
    """(by, group, n_splits) of groups that occur in more than one split."""
    return members.groupBy(*(by or []), group).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def fold_cover(samples: DataFrame, folds: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """(by, key, times) of samples that are not in exactly one fold."""
    by = by or []
    counts = folds.groupBy(*by, key).agg(F.count("*").alias("times"))
    if by:
        samples = samples.select(key).join(F.broadcast(folds.select(*by).distinct()))  # a few repeats
    return samples.select(*by, key).join(counts, [*by, key], "full_outer").na.fill(0, ["times"]).where("times <> 1")


def row_contract(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, problem): missing, unexpected, duplicate or mismatched rows."""
    e = expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_a"), F.struct(*fields).alias("_f"))
    a = actual.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_a"), F.struct(*fields).alias("_f"))
    met = e.unionByName(a).groupBy(*keys).agg(F.sum("_e").alias("e"), F.sum("_a").alias("a"), F.count_distinct("_f").alias("kinds"))
    problem = (
        F.when(F.col("a") == 0, "missing").when(F.col("e") == 0, "unexpected").when((F.col("a") > 1) | (F.col("e") > 1), "duplicate").when(F.col("kinds") > 1, "mismatch")
    )
    return met.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def one_per_group(rows: DataFrame, group: list[str], key: str, seed: int) -> DataFrame:
    """One reproducible random row of every group."""
    order = Window.partitionBy(*group).orderBy(hash_bits(F.lit(seed), F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def split_counts(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, label or null for all, n): a rollup over the label."""
    return rows.rollup(*by, label).agg(F.count("*").alias("n"), F.grouping_id().alias("level")).where("level <= 1").select(*by, label, "n")


def grouped_folds(groups: DataFrame, folds: int, repeats: int, seed: int) -> DataFrame:
    """(repeat, group_id, label, fold): groups dealt whole to folds so that each
    label is spread evenly.

    ``groups``: (group_id, label, n). Labels are independent of each other, so
    each is one Arrow group, of as many rows as it has groups.
    """
    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        repeat = int(pdf["repeat"].iloc[0])
        order = pdf.sort_values(["n", "order", "group_id"], ascending=[False, True, True])
        loads, found = [0] * folds, []
        start = (repeat + sum(map(ord, str(pdf["label"].iloc[0])))) % folds
        for g, n in zip(order["group_id"], order["n"], strict=True):
            f = min(range(folds), key=lambda i: (loads[i], (i - start) % folds))
            loads[f] += int(n)
            found.append(f)
        return order[["repeat", "group_id", "label"]].assign(fold=found)

    each = groups.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    each = each.withColumn("order", hash_bits(F.lit(seed), F.col("repeat"), F.col("group_id")).cast("double"))
    return each.groupBy("repeat", "label").applyInPandas(deal, "repeat int, group_id int, label string, fold int")


def problems_with_notes(notes: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, n_notes, n_invalid, validation_status, exclusion_reason)."""
    valid = (F.col("tick") >= 0) & F.col("pitch").between(0, 127) & F.col("velocity").between(1, 127) & (F.col("duration_ticks") >= 0)
    counts = notes.groupBy(key).agg(F.count("*").alias("n_notes"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("n_invalid"))
    reason = F.when(F.col("n_notes") == 0, "no notes").when(F.col("n_invalid") > 0, "invalid notes")
    return counts.withColumn("exclusion_reason", reason).withColumn("validation_status", F.when(reason.isNull(), "accepted").otherwise("excluded"))


def content_duplicates(files: DataFrame, sha: str, label: str) -> DataFrame:
    """(sha, n, cross_class) of contents that occur more than once."""
    return files.groupBy(sha).agg(F.count("*").alias("n"), (F.count_distinct(label) > 1).alias("cross_class")).where("n > 1")


def quantile_representatives(rows: DataFrame, by: list[str], key: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, share, key): for each quantile in turn the nearest row not yet
    taken, ties by key.

    The pick for the k-th share is one of the k rows nearest to its quantile, so
    only these meet: a few per group, whatever its size.
    """
    rows = checkpoint(rows.select(*by, key, F.col(value).cast("double").alias("_value")))
    quantiles = exact_quantiles(rows, by, "_value", shares).select(*by, F.posexplode("quantiles").alias("_k", "_q"))
    near = Window.partitionBy(*by, "_k").orderBy(F.abs(F.col("_value") - F.col("_q")), key)
    few = rows.join(quantiles, by).withColumn("_at", F.row_number().over(near)).where(F.col("_at") <= len(shares)).where(F.col("_at") <= F.col("_k") + 1)
    turns = few.groupBy(*by, "_k").agg(F.array_sort(F.collect_list(F.struct("_at", F.col(key).alias("key")))).alias("_near"))
    turns = turns.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_k", "_near"))).alias("_turns"))
    kind = f"array<{rows.schema[key].dataType.simpleString()}>"
    first_free = lambda taken, turn: F.filter(turn["_near"]["key"], lambda x: ~F.array_contains(taken, x))
    taken = F.aggregate("_turns", F.array().cast(kind), lambda taken, turn: F.concat(taken, F.slice(first_free(taken, turn), 1, 1)))
    named = turns.select(*by, F.posexplode(taken).alias("_k", key))
    return named.select(*by, F.element_at(F.array(*map(F.lit, shares)), F.col("_k") + 1).alias("share"), key)


def median_representatives(rows: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """(by, key): the row nearest to the group's median, ties by key."""
    rows = checkpoint(rows.select(*by, key, value))
    middle = exact_median(rows, by, value, "_m")
    return rows.join(middle, by).groupBy(*by).agg(F.min_by(key, F.struct(F.abs(F.col(value) - F.col("_m")), key)).alias(key))


def canonical_paths(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, path, others): the first path that is no alternate, by alphabet."""
    rank = F.struct(F.col("path").contains("_no_repeat").cast("int").alias("alternate"), F.lower("path").alias("low"), F.col("path").alias("path"))
    found = files.groupBy(*by).agg(F.min(rank)["path"].alias("path"), F.array_sort(F.collect_set("path")).alias("every"))
    return found.select(*by, "path", F.array_except("every", F.array("path")).alias("others"))


