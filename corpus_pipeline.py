"""A corpus pipeline: five stages over ``documents``, each on what the last kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it again, so a lost
executor costs a stage at most. All stages but the last return the columns of
``documents``. What a stage wrote for itself, and its input, go when its result
is written; checkpoints go where the session has
``spark.cleaner.referenceTracking.cleanCheckpoints``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import delete, own_tables, shared_dir, staged
from tessitura.llm.decontaminate import contaminated
from tessitura.llm.jaccard_join import near_duplicates
from tessitura.llm.mixing import mix_sources
from tessitura.llm.sharding import assign_shards
from tessitura.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the threshold of their language go.
    Rows with a null doc_id are scored and kept or dropped alike."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs.select(*COLUMNS), model, keep=COLUMNS).where("NOT toxic").select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each in place of a doc_id, in a table, so that
    they keep it; null and repeated doc_ids then do no harm."""
    return staged(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row stays: that with the
    smallest doc_id (null last; of rows that repeat it, any one). Rows are
    judged each by its own text, whatever doc_id they have or repeat; rows
    without words are alone and stay."""
    rows = _numbered(docs)
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    stay = found.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min_by("row", order).alias("row"))
    return rows.join(stay.select("row"), "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, with a null or repeated doc_id too:
    each is judged by its own text. Null and empty texts hold nothing."""
    rows = _numbered(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated(rows.select(F.col("row").alias("doc_id"), "text"), benchmark, lenient=True).select(F.col("doc_id").alias("row")).distinct()
    return rows.join(found, "row", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes its words, to the nearest
    whole number: up to twice. Documents without words come never. Rows with a
    null or repeated doc_id count each by itself."""
    mixed = mix_sources(docs, keep=COLUMNS).where("size > 0").withColumn("times", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int"))
    return mixed.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return assign_shards(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can't express the classifier; the pipeline is tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with own_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            delete(spark, f"{base}/{k - 1}")
    return docs
