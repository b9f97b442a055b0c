"""Every labelled row is trained on, however many shards they fill."""

import numpy as np
from pyspark.sql import functions as F

from tessitura.llm import toxicity
from tests.llm.test_classifiers import auc, held_out, labelled


def test_words_of_the_last_rows_by_hash_are_learnt(spark):
    """2,600 rows have label 1; a word is in the 60 that hash highest."""
    ids = spark.range(7000).where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4)) != 2).orderBy(F.xxhash64("id"), "id").toPandas()["id"].tolist()
    ones, zeros = ids[:2600], ids[2600:]
    words = {i: "sploder" for i in ones} | dict.fromkeys(ones[-60:], "grumbix") | {i: f"w{i % 50}" for i in zeros}
    docs = spark.createDataFrame([(i, f"a plain {w} text", "en") for i, w in words.items()] + [(-1, "a plain grumbix text", "en"), (-2, "a plain w7 text", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(w in ("sploder", "grumbix"))) for i, w in words.items()], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.toxicity_report(docs, labels).where("doc_id < 0").collect()}
    assert score[-1] > 0.8 and score[-2] < 0.1


def test_many_shards_learn_and_count_all_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 120)
    rows, labels, table = labelled(spark)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    shards = toxicity.labelled_words(docs, table, 4, 2)
    assert {r.doc_id for r in shards.collect()} == {r.doc_id for r in toxicity.labelled_ids(table, "toxic", 4, 2).collect()}
    assert shards.select("shard").distinct().count() > 3
    got = toxicity.toxicity_report(docs, table).collect()
    scores, y, _ = held_out(got, labels, 2, 4, 2)
    assert auc(scores, y) > 0.9
    again = toxicity.toxicity_report(docs.orderBy(F.desc("doc_id")).repartition(7), table.repartition(3)).collect()
    assert {r.doc_id: r.score for r in got} == {r.doc_id: r.score for r in again}


def test_equal_scores_are_told_apart_by_no_threshold():
    s, y = np.array([0.9, 0.5, 0.5, 0.1]), np.array([1.0, 1.0, 0.0, 0.0])
    assert 0.1 < toxicity._best_threshold(s, y, np.ones(4)) < 0.5
