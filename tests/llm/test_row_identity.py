"""Stages judge rows, not ids; results stay readable beside a pipeline; long words are not remembered."""

from collections import Counter

import numpy as np

import corpus_pipeline
from tessitura.llm import common, quality, token_count, toxicity
from tessitura.llm.decontaminate import contaminated
from tests.llm.fixtures import frame
from tests.llm.test_pairs import QUESTION


def prose(name, n=30):
    return " ".join(f"{name}{k}" for k in range(n))


def test_near_duplicates_of_a_repeated_id_are_judged_by_their_own_text(spark, sf_dir):
    rows = [(3, prose("w"), "en", "a"), (7, prose("w") + " x", "en", "a"), (7, prose("u"), "en", "a"), (None, prose("w"), None, None), (None, prose("v"), None, None), (9, "", "en", "a"), (9, None, "en", "a")]
    rows += [(5, prose("z"), "en", "a"), (4, prose("z"), "en", "b"), (4, prose("z"), "en", "b")]
    got = corpus_pipeline.near_duplicate(spark, frame(spark, rows).repartition(4), sf_dir).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(3, prose("w")), (7, prose("u")), (None, prose("v")), (9, ""), (9, None), (4, prose("z"))])


def test_rows_without_or_with_a_repeated_id_are_decontaminated(spark, tmp_path):
    spark.createDataFrame([(10, QUESTION)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, QUESTION, "en", "a"), (None, prose("v"), "en", "a"), (1, QUESTION, "en", "a"), (1, prose("u"), "en", "a"), (2, None, "en", "a")]
    got = corpus_pipeline.decontamination(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, prose("v")), (1, prose("u")), (2, "")]


def test_a_result_not_yet_read_outlives_other_calls_tables(spark):
    items = spark.createDataFrame([(10, QUESTION)], "item_id long, text string")
    pending = contaminated(frame(spark, [(1, QUESTION, "en", "a")]), items)
    with common.own_tables(spark):
        inner = common.staged(spark.range(3))
        assert inner.count() == 3
    assert [r.doc_id for r in pending.collect()] == [1]
    assert not spark._jvm.org.apache.hadoop.fs.Path(inner.inputFiles()[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(inner.inputFiles()[0]))


def test_long_words_are_not_remembered():
    words = [bytes([65 + k % 26]) * 100_000 + str(k).encode() for k in range(200)]
    hashes, table, rows, pairs, counts = common.WordHashes(), common.WordTable(lambda w: (len(w), 1), 2), toxicity._Rows(), quality._Pairs(), token_count._Counts(token_count.LongestMatch(["a", "▁"]))
    assert len(set(hashes.of(words).tolist())) == 200
    assert table.of(words)[:, 0].tolist() == list(map(len, words)) and table.of([b"a", words[0]])[:, 0].tolist() == [1, len(words[0])]
    assert len(set(rows.of(b" ".join(words)).tolist())) == 200 and len({pairs[w] for w in words}) == 200
    assert counts[words[0]] >= 1
    assert not any(len(w) > common.LONGEST for memory in (hashes, table, rows, pairs, counts) for w in memory)


def test_scores_of_a_word_do_not_depend_on_its_company():
    rng = np.random.default_rng(3)
    model = toxicity.ToxicityModel(
        rng.normal(0, 1, (toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), [rng.normal(0, 1, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        np.zeros(24, np.float32), np.ones(25, np.float32),
    ).rounded()
    rows = rng.integers(0, toxicity.BUCKETS, (500, 4))
    every = model.responses(rows)
    assert all(np.array_equal(every[k : k + 1], model.responses(rows[k : k + 1])) for k in range(0, 500, 7))
    assert np.array_equal(every[::-1], model.responses(rows[::-1]))
