"""Logistic regressions fitted together against plain Newton steps; open-set scenarios against plain counting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import logistic, scenario


def plain_fit(x, y, c, labels):
    counts = np.bincount(y, minlength=labels)
    present = counts > 0
    std = x.std(0)
    z = np.hstack([np.where(std > 0, (x - x.mean(0)) / np.where(std > 0, std, 1), 0), np.ones((len(x), 1))])
    w = (len(y) / (present.sum() * np.maximum(counts, 1)))[y]
    onehot = np.eye(labels)[y]
    beta = np.zeros((labels, z.shape[1]))
    free = np.ones_like(beta)
    free[:, -1] = 0
    for _ in range(200):
        s = np.where(present, z @ beta.T, -np.inf)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (c * ((p - onehot) * w[:, None]).T @ z + beta * free).ravel()
        h = np.diag(free.ravel())
        for i in range(len(z)):
            h = h + c * w[i] * np.kron(np.diag(p[i]) - np.outer(p[i], p[i]), np.outer(z[i], z[i]))
        move = -np.linalg.lstsq(h, g, rcond=1e-13)[0]
        beta = beta + 0.7 * move.reshape(beta.shape)
        if np.abs(move).max() < 1e-10:
            break
    return beta, z


def test_coefficients_are_those_of_plain_newton_steps(spark, monkeypatch):
    monkeypatch.setattr(logistic, "PART_ROWS", 25)
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for cell, c, labels, n in (("a", 1.0, 3, 80), ("b", 10.0, 3, 60), ("c", 0.05, 2, 30)):
        y = rng.integers(0, labels, n)
        x = rng.normal(size=(n, 4)) * np.array([1, 5, 0.1, 1]) + y[:, None] * np.array([1, 0, 0.05, -1]) + 3
        x[:, 3] = 7.0 if cell == "c" else x[:, 3]
        rows += [(cell, int(i), int(y[i]), x[i].tolist()) for i in range(n)]
        want[cell] = (*plain_fit(x, y, c, 3), y)
    df = spark.createDataFrame(rows, "cell string, piece_id long, label int, x array<double>")
    settings = spark.createDataFrame([("a", 1.0), ("b", 10.0), ("c", 0.05), ("none", 1.0)], "cell string, c double")
    fits = logistic.fit_logistic(df.repartition(5), settings, 3)
    got = {r.cell: np.array(r.base).reshape(3, -1) for r in fits.collect()}
    assert set(got) == {"a", "b", "c"}
    p = {(r.cell, r.piece_id, r.label): r.p for r in logistic.predict_logistic(df, fits).collect()}
    for cell, (beta, z, y) in want.items():
        assert np.allclose(got[cell][:, :-1], beta[:, :-1], atol=1e-6)
        of = np.exp(z @ beta.T) * (np.bincount(y, minlength=3) > 0)
        of /= of.sum(1, keepdims=True)
        assert all(p[cell, i, k] == pytest.approx(of[i, k], abs=1e-7) for i in range(len(y)) for k in range(3))
    again = {r.cell: r.base for r in logistic.fit_logistic(df.orderBy(F.desc("piece_id")), settings, 3).collect()}
    assert all(list(got[k].ravel()) == list(again[k]) for k in got)


def test_scenarios_score_everybody_once_and_train_on_known_labels_only(spark):
    samples = spark.createDataFrame([(i, "abcd"[i % 4], i // 4 % 3) for i in range(48)], "piece_id long, label string, fold int")
    plan = spark.createDataFrame(scenario.rotations(list("abcd")), "scenario string, calibration string, test string")
    rows = scenario.parts_of(samples, plan, 3, 5).collect()
    for name in {r.scenario for r in rows}:
        scored = [r.piece_id for r in rows if r.scenario == name and not r.is_train]
        assert sorted(scored) == list(range(48))
        assert all(r.role == "known" for r in rows if r.scenario == name and r.is_train)
        assert not {(r.fold, r.piece_id) for r in rows if r.scenario == name and r.is_train} & {(r.fold, r.piece_id) for r in rows if r.scenario == name and not r.is_train}


def test_thresholds_and_metrics_are_those_of_plain_counting(spark):
    rng = np.random.default_rng(9)
    rows = [(s, round(float(rng.beta(4, 2) if k % 3 else rng.beta(2, 4)), 2), bool(k % 3), "xy"[k % 2], "xy"[int(rng.integers(2))]) for s in "pq" for k in range(90)]
    df = spark.createDataFrame(rows, "scenario string, score double, is_known boolean, true_label string, predicted string").repartition(4)
    limits = scenario.thresholds(df, 0.8)
    got = {r.scenario: r for r in scenario.scenario_metrics(df, limits, 0.8).collect()}
    for s in "pq":
        known, unknown = (np.array([r[1] for r in rows if r[0] == s and r[2] is k]) for k in (True, False))
        best = max((round(((known >= t).mean() + (unknown < t).mean()) / 2, 12), round((unknown < t).mean(), 12), t) for t in {*known, *unknown} if (known >= t).mean() + 1e-12 >= 0.8)
        t = best[2]
        r = got[s]
        assert r.threshold == t and (r.n_known, r.n_unknown) == (60, 30)
        assert r.auroc == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in known for b in unknown]))
        steps = sorted({*known, *unknown}, reverse=True)
        assert r.auprc == pytest.approx(sum((known == x).sum() / 60 * (known >= x).sum() / ((known >= x).sum() + (unknown >= x).sum()) for x in steps))
        assert r.fpr_at_tpr == pytest.approx(min((unknown >= x).mean() for x in steps if (known >= x).mean() >= 0.8))
        assert (r.known_recall, r.unknown_recall) == (pytest.approx((known >= t).mean()), pytest.approx((unknown < t).mean()))
        recalls = [np.mean([p == y for z, x, k, y, p in rows if z == s and k and x >= t and y == lab]) for lab in "xy"]
        assert r.accepted_balanced_accuracy == pytest.approx(np.mean(recalls))
