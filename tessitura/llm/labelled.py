"""Labelled documents for fitting classifiers: all of them, or reproducible samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(doc_id, folds: int):
    """crc32 of the doc_id as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def labelled_ids(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, y) of every labelled row outside the held-out fold, one a doc_id.
    Rows with a null doc_id or label are left out; doc_ids of any whole-number
    type are read as long."""
    return (
        labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("doc_id"), folds) != held))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> tuple[DataFrame, float]:
    """At most ``most`` rows (doc_id, text, lang, y), half of each label where
    there are enough, outside the held-out fold; and label 1's share among all
    labelled rows outside that fold. The rows are those whose doc_id hashes
    lowest, and of texts that repeat a doc_id the one that hashes lowest counts,
    so reruns agree however the tables are dealt. Rows with a null doc_id or
    label are left out; doc_ids of any whole-number type are read as long."""
    known = labelled_ids(labels, label, folds, held)
    share = known.agg(F.avg("y")).first()[0]
    order = F.xxhash64("doc_id")
    halves = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(most // 2) for y in (0, 1)]
    chosen = F.broadcast(halves[0].unionAll(halves[1]))  # at most `most` rows
    met = docs.select(F.col("doc_id").cast("long"), "text", "lang").join(chosen, "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "lang", "y")).alias("one")
    return met.groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.lang", "one.y"), 0.0 if share is None else share
