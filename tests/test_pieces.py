"""Pieces measured in numpy against the operators of the six groups."""

import random

import pytest
from pyspark.sql import functions as F

from tessitura.operators import features

NOTE = "piece_id long, tick long, channel int, pitch int, velocity int, duration_ticks long"
METER = "piece_id long, tick long, numerator int, denominator int"


def _pieces(seed):
    draw = random.Random(seed)
    rows = [(p, draw.randrange(40) * 60, 0, draw.randrange(36, 60), 80, draw.randrange(0, 9) * 60) for p in range(8) for _ in range(1 + 12 * p)]
    rows += [(20, 0, 0, 60, 80, 0), (21, 0, 0, 60, 80, 0), (21, 0, 0, 64, 80, 0), (21, 0, 0, 64, 80, 0), (22, 5, 0, 0, 80, 1), (23, 100, 0, 60, 80, None), (23, 240, 0, 61, 80, 480)]
    meter = [(p, 0, 4, 4) for p in range(6)] + [(p, 700, 3, 4) for p in range(3, 8)] + [(2, 400, 0, 4), (4, 1300, 6, 8), (99, 0, 4, 4)]
    return rows, meter


def test_vectors_agree_with_the_groups(spark):
    rows, meter = _pieces(3)
    notes, changes = spark.createDataFrame(rows, NOTE), spark.createDataFrame(meter, METER)
    got = {r.piece_id: r for r in features.composition_vector(notes, changes, 480).collect()}
    want = {r.piece_id: r for r in features.composition_groups(notes, changes, 480).collect()}
    assert got.keys() == want.keys() and len(got) == 12
    for p, row in want.items():
        for name in features.COMPOSITION_FEATURES:
            assert got[p][name] == pytest.approx(row[name], abs=1e-9), (p, name)


def test_notes_are_shuffled_once_for_all_features(spark):
    notes, changes = spark.createDataFrame(_pieces(1)[0], NOTE), spark.createDataFrame(_pieces(1)[1], METER)
    plan = features.composition_vector(notes, changes, 480).where(F.col("pitch_mean") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 3
