import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessitura.operators import evaluation


def test_only_single_values_are_dealt_anew(spark):
    rows = [(i, "ab"[i % 3 % 2], [float(i * 7 % 11), float(i * 5 % 13)]) for i in range(30)]
    seen = []

    def scored(df):
        seen.append(df)
        return df.withColumn("predicted_label", F.when(F.col("vector")[0] > F.col("vector")[1], "a").otherwise("b"))

    vectors = spark.createDataFrame(rows, "piece_id long, composer string, vector array<double>")
    got = {r.feature: r for r in evaluation.permutation_drop(scored, vectors, [0, 1], repeats=2, seed=3).collect()}
    guess = lambda v: "a" if v[0] > v[1] else "b"
    base = sum(guess(v) == label for _, label, v in rows) / 30
    for f in (0, 1):
        drops = []
        for again in (0, 1):
            order = sorted(range(30), key=lambda i: int(hashlib.sha256(f"3|{f}|{again}|{i}".encode()).hexdigest()[:16], 16))
            new = [[rows[order[i]][2][k] if k == f else x for k, x in enumerate(v)] for i, _, v in rows]
            drops.append(base - sum(guess(v) == label for v, (_, label, _) in zip(new, rows, strict=True)) / 30)
        assert got[f].mean_drop == pytest.approx(sum(drops) / 2)
    # No window sorts whole vectors.
    plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString()
    below = re.findall(r"Window \[.*\n(.*Project .*)", plan)
    assert below and not any(re.search(r"(?<![(\w])vector#\d+", line) for line in below)
