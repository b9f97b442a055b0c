"""Exact duplicates by a content sort.

The normalised bytes are range-partitioned by splitters that Spark samples,
sorted within each range (an external sort, so a range may exceed memory), and
neighbours are compared in full: rows of one run have identical bytes.

A text that many rows share would fill one range. Texts with more than
``1 / (4 * partitions)`` of the rows, of which there can be at most
``4 * partitions``, are therefore found first by a map-side combined count and
dealt over several runs, whose heads are then merged. Every row takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, ceil_div, checkpointed, partitions

#: Bytes of the normalised text in the sampled sort key; the hash behind them
#: keeps texts with one beginning apart, the sort then compares whole texts.
HEAD_BYTES = 32


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): which of its equals stays.

    Texts are equal when identical after ASCII white space is deleted. Of
    equals, the row whose original text has the most code points stays, then
    the smallest doc_id. A null text counts as empty; a null doc_id sorts last;
    of rows that repeat a doc_id with one text, one stays. Other columns are
    ignored.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    parts = partitions(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.char_length(text).alias("chars"),
        F.regexp_replace(text, f"{SPACE}+", "").alias("norm"),
    ).withColumn("hash", F.xxhash64("norm"))

    share = max(1, ceil_div(docs.count(), 4 * parts))
    hot = (
        rows.groupBy("hash")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > share)
        .select("hash", F.ceil(F.col("n") / share).alias("ways"))
    )
    dealt = (
        rows.join(F.broadcast(hot), "hash", "left")
        .withColumn("run", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("ways")), F.lit(0)))
        .withColumn("head", F.substring(F.col("norm").cast("binary"), 1, HEAD_BYTES))
        .repartitionByRange(parts, "head", "hash", "run")
    )
    # The range partitioning already keeps a run together, so neither of these
    # windows shuffles; the sort by "norm" makes equals neighbours.
    ordered = Window.partitionBy("head", "hash", "run", "norm").orderBy(
        F.col("chars").desc(), F.col("doc_id").asc_nulls_last()
    )
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = checkpointed(
        dealt.select(
            "doc_id",
            "run",
            F.col("ways").isNotNull().alias("split"),
            F.first("doc_id").over(whole).alias("run_keep"),
            F.first("chars").over(whole).alias("run_chars"),
            F.count("*").over(whole).alias("run_size"),
            F.row_number().over(ordered).alias("place"),
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        )
    )
    merged = (
        runs.where("split AND place = 1")
        .groupBy("text_sha256")
        .agg(
            F.min(F.struct((-F.col("run_chars")).alias("c"), F.col("run_keep").isNull().alias("no_id"), F.col("run_keep").alias("id"), F.col("run").alias("run"))).alias("best"),
            F.sum("run_size").alias("all_size"),
        )
    )
    merged = merged.select("text_sha256", "all_size", F.col("best.id").alias("best_id"), F.col("best.run").alias("best_run"))
    return runs.join(F.broadcast(merged), "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("all_size").isNull(), F.col("run_keep")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        ((F.col("place") == 1) & (F.col("all_size").isNull() | (F.col("run") == F.col("best_run")))).alias("kept"),
        "text_sha256",
    )
