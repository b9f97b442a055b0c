"""Toxicity, quality and the pipeline: held-out accuracy and awkward rows."""

import random
import zlib

import numpy as np
import pytest

from tessitura.llm import quality, toxicity
from tests.llm.fixtures import AWKWARD, frame

BAD = ("grumbix", "sploder", "fenwick")


def labelled(spark, n=900, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        toxic, junk = rng.random() < 0.2, rng.random() < 0.3
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(BAD) + rng.choice(("", ".", "ling"))
        if junk:
            w = [x + "$$$" for x in w]
        rows.append((i, " ".join(w), rng.choice(("en", "de")), "a"))
        if i % 10:
            labels.append((i, int(not junk), int(toxic), "x"))
    return rows, labels, spark.createDataFrame(labels + [(None, 1, 1, "x"), (5, None, None, "x")], "doc_id long, quality int, toxic int, lang string")


def auc(scores, y):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held_out(got, labels, column, folds, held):
    by = {r.doc_id: r for r in got}
    rows = [(by[i], row[column]) for row in labels for i in (row[0],) if zlib.crc32(str(i).encode()) % folds == held]
    assert all(r.held_out for r, _ in rows)
    return np.array([r.score for r, _ in rows]), np.array([y for _, y in rows]), np.array([r.predicted for r, _ in rows])


def test_toxicity_is_learnt(spark):
    rows, labels, table = labelled(spark)
    got = toxicity.toxicity_report(frame(spark, rows + AWKWARD), table).collect()
    assert len(got) == len(rows) + len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    scores, y, predicted = held_out(got, labels, 2, 4, 2)
    assert auc(scores, y) > 0.95 and (predicted == y).mean() > 0.93


def test_quality_is_learnt(spark):
    rows, labels, table = labelled(spark)
    got = quality.quality_report(frame(spark, rows + AWKWARD), table).collect()
    assert len(got) == len(rows) + len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    scores, y, predicted = held_out(got, labels, 1, 3, 1)
    assert auc(scores, y) > 0.98 and (predicted == y).mean() > 0.95


@pytest.mark.parametrize("report", [toxicity.toxicity_report, quality.quality_report])
def test_no_held_out_label_and_no_language_matters(spark, report):
    rows, labels, table = labelled(spark, 300)
    folds, held = (4, 2) if report is toxicity.toxicity_report else (3, 1)
    other = [(i, 1 - q, 1 - t, x) if zlib.crc32(str(i).encode()) % folds == held else (i, q, t, x) for i, q, t, x in labels]
    flipped = spark.createDataFrame(other, "doc_id long, quality int, toxic int, lang string")
    plain = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, lang string")
    renamed = [(i, t, "xx", "yy") for i, t, *_ in rows]
    score = lambda rs, ls: {r.doc_id: r.score for r in report(frame(spark, rs), ls).collect()}
    first = score(rows, plain)
    assert first == score(rows, flipped) == score(renamed, plain)


@pytest.mark.parametrize("report", [toxicity.toxicity_report, quality.quality_report])
def test_without_labels_or_rows(spark, report):
    rows, _, table = labelled(spark, 60)
    none = table.where("false")
    assert len({r.score for r in report(frame(spark, rows), none).collect()}) == 1
    assert report(frame(spark, []), table).count() == 0


def test_convolution_against_a_plain_one():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 500, (n, 4)).astype(np.int32) for n in (1, 2, 3, 40)]
    model = toxicity.train(docs * 6, np.array([0, 1, 0, 1] * 6, np.float32), 0.3, ["en"] * 24, epochs=1)
    for rows in docs:
        vectors = model.embed[rows].sum(1)
        best = []
        for f in model.filters:
            w = len(f)
            padded = np.concatenate([vectors, np.zeros((max(0, w - len(vectors)), vectors.shape[1]), np.float32)])
            best.append(np.max([sum(padded[i + k] @ f[k] for k in range(w)) for i in range(len(padded) - w + 1)], 0))
        assert np.allclose(np.concatenate(best), model.pooled(model.responses(rows)), atol=1e-5)


def test_updates_follow_the_regularised_leader():
    """One coordinate, one example: the closed form of the first update."""
    model = quality.train([(np.array([3]), np.array([1.0]))], np.array([1.0]), 0.5, epochs=1)
    g = -0.5
    z, n = g, g * g
    want = -(z - np.sign(z) * 0.02) / ((1.0 + np.sqrt(n)) / 0.5 + 0.02)
    assert model.weights[3] == pytest.approx(want) and np.count_nonzero(model.weights) == 1


def test_pipeline_stages_take_effect(spark, sf_dir):
    import corpus_pipeline
    from tests.llm.test_pairs import shingles

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs.collect())
    before, clean, apart, free, mixed = ({r.doc_id: r for r in rows} for rows in seen)
    assert len(clean) < len(before) and set(mixed) <= set(free) <= set(apart) <= set(clean)
    sets = {i: shingles(r.text) for i, r in apart.items()}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                assert 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(item in r.text for r in free.values() for item in items)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == len(seen[-1])


def test_pipeline_survives_awkward_rows(spark, sf_dir):
    import corpus_pipeline

    docs = frame(spark, AWKWARD)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


@pytest.mark.parametrize("report", [toxicity.toxicity_report, quality.quality_report])
def test_repeated_and_narrow_ids_fit_alike_however_the_table_is_dealt(spark, report):
    rows, labels, table = labelled(spark, 200)
    rows += [(i, f"other text {i} grumbix", "en", "a") for i in range(0, 200, 3)]
    score = lambda df, ls: {(r.doc_id, round(r.score, 12)) for r in report(df, ls).collect()}
    first = score(frame(spark, rows), table)
    assert first == score(frame(spark, rows[::-1]).repartition(7), table.repartition(3))
    narrow = frame(spark, rows).selectExpr("cast(doc_id AS int) AS doc_id", "text", "lang", "source")
    assert first == score(narrow, table.selectExpr("cast(doc_id AS int) AS doc_id", "quality", "toxic"))


def test_pooling_by_stretches_is_pooling_of_the_whole(monkeypatch):
    monkeypatch.setattr(toxicity, "STRETCH", 5)
    rng = np.random.default_rng(1)
    table = rng.normal(0, 1, (50, sum(toxicity.WIDTHS) * toxicity.FILTERS)).astype(np.float32)
    for n in (*range(25), 400):
        at = rng.integers(0, 50, n)
        assert np.array_equal(toxicity._pool_in_stretches(table, at), toxicity._pool(table[at])[0])
