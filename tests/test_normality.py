"""Shapiro-Wilk, signed ranks and the choice between tests, against published and counted values."""

import itertools
import random

import pytest

from tessitura.operators import normality

#: Published examples: weights of eleven men; and small sets with known statistics.
MEN = (148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236)


def test_shapiro_wilk_gives_published_values(spark):
    rows = [("men", float(x)) for x in MEN] + [("three", x) for x in (1.0, 2.0, 3.0)] + [("flat", 5.0)] * 4 + [("two", 1.0), ("two", 2.0), ("none", None)]
    got = {r.g: r for r in normality.shapiro_wilk(spark.createDataFrame(rows, "g string, x double").repartition(3), "x", ["g"]).collect()}
    assert got["men"].w == pytest.approx(0.7888, abs=2e-4) and got["men"].p == pytest.approx(0.0067, abs=2e-4)
    assert got["three"].w == pytest.approx(1.0) and got["three"].p == pytest.approx(1.0)
    assert got["flat"].w is None and got["two"].p is None and "none" not in got


def test_normal_values_are_seldom_refused(spark):
    rng = random.Random(3)
    rows = [(f"{n}|{kind}|{k}", rng.gauss(5, 2) if kind == "normal" else rng.expovariate(1)) for n in (5, 10, 12, 40) for kind in ("normal", "skew") for k in range(60) for _ in range(n)]
    got = normality.shapiro_wilk(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]).collect()
    refused = lambda kind, n: sum(r.p < 0.05 for r in got if r.g.split("|")[:2] == [str(n), kind]) / 60
    assert all(refused("normal", n) < 0.17 for n in (5, 10, 12, 40))
    assert refused("skew", 40) > 0.9 and all(0 < r.w <= 1 and 0 <= r.p <= 1 for r in got)


def test_signed_rank_distribution_is_that_of_all_sign_patterns():
    for n in (1, 4, 7):
        sums = [sum(k for k, s in enumerate(signs, 1) if s) for signs in itertools.product((0, 1), repeat=n)]
        assert list(normality.rank_sum_counts(n)) == [sums.count(k) for k in range(n * (n + 1) // 2 + 1)]
        for w in range(n * (n + 1) // 4 + 1):
            assert normality.exact_signed_rank_p(n, w) == min(1.0, 2 * sum(s <= w for s in sums) / 2**n)


def test_the_test_is_chosen_by_normality_and_number(spark):
    rng = random.Random(8)
    rows = [("normal", 0.0, rng.gauss(1, 1)) for _ in range(30)] + [("skew", 0.0, rng.expovariate(1) ** 3 + 0.001 * k) for k in range(20)] + [("few", 0.0, 1.0 + k) for k in range(9)]
    rows += [("same", 2.0, 2.0)] * 12 + [("tied", 0.0, float(x)) for x in (1, 1, 1, 1, 1, 1, 1, 1, 1, 40, -1, 90)] + [("normal", None, 1.0)]
    got = {r.g: r for r in normality.chosen_tests(spark.createDataFrame(rows, "g string, a double, b double"), "a", "b", ["g"]).collect()}
    assert {g: (r.n, r.test) for g, r in got.items()} == {"normal": (30, "paired t"), "skew": (20, "signed rank"), "few": (9, "descriptive"), "same": (12, "signed rank"), "tied": (12, "signed rank")}
    assert got["few"].p is None and got["few"].statistic is None and got["few"].significant is None
    assert got["same"].p == 1.0 and got["same"].normality_p is None and not got["same"].significant
    assert got["skew"].statistic == 0 and got["skew"].p == 2 / 2**20 and got["normal"].significant
    assert 0 < got["tied"].p < 0.05
