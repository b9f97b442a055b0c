"""Order statistics by radix selection and sums in any order, against numpy and fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import contracts, exact, order, profiles

VALUES = [0.0, -0.0, 1.5, -1.5, 1e-310, -1e-310, 5e300, -5e300, math.inf, -math.inf, 3.0, 3.0, 3.0, -7.25, 2.0**-1074, 1 + 2.0**-52, 1.0]


def test_bits_sort_as_the_doubles_do(spark):
    df = spark.createDataFrame([(float(v),) for v in VALUES], "v double").select("v", order.sortable_bits("v").alias("b"))
    rows = [(r.v, r.b % 2**64) for r in df.select("v", "b").collect()]
    assert [v for v, _ in sorted(rows, key=lambda x: x[1])] == sorted(v for v, _ in rows)
    back = df.select("v", order.from_sortable_bits("b").alias("x")).collect()
    assert all(r.v == r.x for r in back)


@pytest.mark.parametrize("shares", [(0.5,), (0.0, 0.25, 0.5, 0.75, 1.0)])
def test_quantiles_are_those_of_numpy(spark, shares):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=501), "b": np.round(rng.normal(size=300) * 3), "c": np.array([2.5]), "d": np.concatenate([np.full(400, 7.0), 10.0 ** rng.uniform(-300, 300, 99)]), "e": np.array([x for x in VALUES if math.isfinite(x)])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("z", None)]
    got = {r.g: (r.n, r.quantiles) for r in order.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g][0] == len(vs)
        plain = sorted(vs)
        for share, x in zip(shares, got[g][1], strict=True):
            at = (len(vs) - 1) * share
            low, high = math.floor(at), math.ceil(at)
            want = plain[low] if plain[low] == plain[high] else (high - at) * plain[low] + (at - low) * plain[high]
            assert x == want
    whole = order.exact_median(spark.createDataFrame([(float(i),) for i in range(10)], "v double"), [], "v").collect()
    assert [r.median for r in whole] == [4.5]
    assert order.exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", shares).count() == 0


def test_sums_are_the_same_bits_in_any_order(spark):
    rng = np.random.default_rng(2)
    rows = [(k % 3, float(v)) for k, v in enumerate(rng.normal(size=999) * 10.0 ** rng.uniform(-12, 3, 999))]
    df = spark.createDataFrame(rows, "g int, value double")
    seen = {tuple(sorted(map(tuple, exact.exact_means(d, ["g"]).collect()))) for d in (df, df.repartition(7), df.orderBy(F.desc("value")), spark.createDataFrame(rows[::-1], df.schema).repartition(3, "value"))}
    assert len(seen) == 1
    for g, n, mean, var in seen.pop():
        mine = [Fraction(v) for k, v in rows if k == g]
        middle = sum(mine) / len(mine)
        assert n == len(mine) and mean == pytest.approx(float(middle), rel=1e-15)
        assert var == pytest.approx(float(sum((x - middle) ** 2 for x in mine) / len(mine)), rel=1e-14)


def test_covariances_are_the_same_bits_in_any_partitioning(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 1e6
    rows = [(int(k % 2), *map(float, v)) for k, v in enumerate(x)] + [(9, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    seen = {repr(sorted((r.g, r.n, r.means, r.cov) for r in exact.exact_covariances(d, names, ["g"]).collect())) for d in (df, df.repartition(6), df.orderBy(F.desc("a")))}
    assert len(seen) == 1
    for r in exact.exact_covariances(df, names, ["g"]).collect():
        mine = np.array([v[1:] for v in rows if v[0] == r.g])
        want = np.cov(mine.T)[np.triu_indices(4)] if len(mine) > 1 else np.zeros(10)
        assert np.allclose(r.cov, want, rtol=1e-8) and np.allclose(r.means, mean := mine.mean(0), rtol=1e-15), mean


def test_representatives_are_taken_in_turn(spark):
    rows = [("a", k, float(v)) for k, v in enumerate([1, 1, 1, 1, 9])] + [("b", 7, 2.0)]
    got = contracts.quantile_representatives(spark.createDataFrame(rows, "g string, k long, v double"), ["g"], "k", "v", (0.25, 0.5, 0.75)).collect()
    assert sorted(map(tuple, got)) == [("a", 0.25, 0), ("a", 0.5, 1), ("a", 0.75, 2), ("b", 0.25, 7)]


def test_plans_hold_no_value_lists(spark):
    long = spark.range(100).selectExpr("'x' AS g", "0 AS idx", "CAST(id AS DOUBLE) AS value")
    plan = profiles.corpus_stats(long, ["g"])._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()
