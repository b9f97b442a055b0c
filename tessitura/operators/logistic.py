"""Many multinomial logistic regressions at once, by Newton steps in lockstep.

Every cell (a fold, a setting, a rotation) has its own rows, weights and
penalty. An iteration is one pass: parts of a cell's rows give their share of
objective, gradient and Hessian as Arrow groups, which add up by cell, and each
cell solves its own small system; cells whose objective rose halve their step.
A part has a bounded number of rows, so a cell may have any number; shares are
added in the order of the parts, so reruns give the same bits.

The objective is ``c * sum(w * -log p) + |coef|^2 / 2`` over standardised
features, intercepts free, ``w`` balancing the labels present.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import checkpoint

PART_ROWS = 20_000
ITERATIONS = 60
TOLERANCE = 1e-9
_STATE = "cell string, c double, mean array<double>, std array<double>, counts array<double>, base array<double>, step array<double>, beta array<double>, objective double, t double, moved double"


def _matrix(pdf: pd.DataFrame, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Standardised features; 0 for those that don't vary; a last column of ones."""
    x = np.vstack(pdf["x"].to_numpy())
    z = np.divide(x - mean, std, out=np.zeros_like(x), where=std > 0)
    return np.hstack([z, np.ones((len(z), 1))])


def shares_of(z: np.ndarray, beta: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Probabilities of the labels; those without training rows have none."""
    score = np.where(present, z @ beta.T, -np.inf)
    e = np.exp(score - score.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def pieces_of(z: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray, present: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, Hessian) of some rows, without penalty."""
    p = shares_of(z, beta, present)
    loss = float(-(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
    q = p.copy()
    q[np.arange(len(y)), y] -= 1
    k, d = beta.shape
    hessian = np.zeros((k, d, k, d))
    for a in range(k):
        for b in range(a, k):
            share = w * (p[:, a] * ((a == b) - p[:, b]))
            hessian[a, :, b] = hessian[b, :, a] = z.T @ (share[:, None] * z)
    return loss, (q * w[:, None]).T @ z, hessian.reshape(k * d, k * d)


def _dealt(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """With ``part``, and into how many parts the cells are dealt."""
    most = rows.groupBy("cell").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    parts = -(-most // PART_ROWS)
    return checkpoint(rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))), parts


def _by_part(state: DataFrame, parts: int) -> DataFrame:
    return state.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("cell", "part")


def _summed(rows: DataFrame, state: DataFrame, parts: int, key: str, share, settle, schema: str) -> DataFrame:
    """``settle(state of a cell, sum of its parts' shares)`` for every cell."""
    def local(group, own: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        if own.empty or its.empty:
            return pd.DataFrame({"cell": [], "part": [], "sums": []}, dtype=object)
        return pd.DataFrame({"cell": [group[0]], "part": [group[1]], "sums": [share(own.sort_values(key), its.iloc[0])]})

    def whole(group, some: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        if some.empty or its.empty:
            return its.iloc[:0].astype(object)
        return pd.DataFrame([settle(its.iloc[0].to_dict(), np.vstack(some.sort_values("part")["sums"].to_numpy()).sum(0))])

    partial = rows.groupBy("cell", "part").cogroup(_by_part(state, parts)).applyInPandas(local, "cell string, part int, sums array<double>")
    return checkpoint(partial.groupBy("cell").cogroup(state.groupBy("cell")).applyInPandas(whole, schema))


def fit_logistic(rows: DataFrame, settings: DataFrame, labels: int, key: str = "piece_id") -> DataFrame:
    """(cell, counts, mean, std, base): the fit of every cell; ``base`` holds the
    coefficients label by label, each label's intercept last.

    ``rows``: (cell, key, label from 0, x), the training rows; ``settings``:
    (cell, c). Cells without rows are left out.
    """
    rows, parts = _dealt(rows.select("cell", key, "label", "x"), key)
    empty = F.array().cast("array<double>")
    zero = F.lit(0.0)
    state = settings.select("cell", F.col("c").cast("double").alias("c"), *[empty.alias(x) for x in ("mean", "std", "counts", "base", "step", "beta")], F.lit(float("inf")).alias("objective"), F.lit(1.0).alias("t"), zero.alias("moved"))

    def first(own: pd.DataFrame, its: pd.Series) -> np.ndarray:
        return np.concatenate([np.bincount(own["label"], minlength=labels), np.vstack(own["x"].to_numpy()).sum(0)])

    def means(its: dict, sums: np.ndarray) -> dict:
        return its | {"counts": sums[:labels], "mean": sums[labels:] / sums[:labels].sum()}

    state = _summed(rows, state, parts, key, first, means, _STATE)

    def second(own: pd.DataFrame, its: pd.Series) -> np.ndarray:
        return ((np.vstack(own["x"].to_numpy()) - its["mean"]) ** 2).sum(0)

    def spread(its: dict, sums: np.ndarray) -> dict:
        std = np.sqrt(sums / np.sum(its["counts"]))
        start = np.zeros(labels * (len(std) + 1))
        # What differs by rounding alone does not vary.
        return its | {"std": np.where(std > 1e-12 * np.maximum(np.abs(its["mean"]), 1e-300), std, 0.0), "base": start, "step": start, "beta": start}

    state = _summed(rows, state, parts, key, second, spread, _STATE)

    def shape(its) -> tuple[np.ndarray, np.ndarray]:
        return np.array(its["beta"]).reshape(labels, -1), np.array(its["counts"]) > 0

    def newton(own: pd.DataFrame, its: pd.Series) -> np.ndarray:
        beta, present = shape(its)
        counts = np.array(its["counts"])
        weight = np.divide(counts.sum(), present.sum() * counts, out=np.zeros(labels), where=present)
        y = own["label"].to_numpy(int)
        loss, gradient, hessian = pieces_of(_matrix(own, its["mean"], its["std"]), y, weight[y], beta, present)
        return np.concatenate([[loss], gradient.ravel(), hessian[np.triu_indices(len(hessian))]])

    def step(its: dict, sums: np.ndarray) -> dict:
        beta, _ = shape(its)
        k, d = beta.shape
        free = np.ones((k, d))
        free[:, -1] = 0  # intercepts bear no penalty
        objective = its["c"] * sums[0] + ((beta * free) ** 2).sum() / 2
        if objective > its["objective"] + 1e-12 * abs(its["objective"]) and its["t"] > 1e-9:
            t = its["t"] / 2
            return its | {"t": t, "beta": np.array(its["base"]) + t * np.array(its["step"])}
        gradient = its["c"] * sums[1 : 1 + k * d] + (beta * free).ravel()
        hessian = np.zeros((k * d, k * d))
        hessian[np.triu_indices(k * d)] = its["c"] * sums[1 + k * d :]
        hessian = hessian + np.triu(hessian, 1).T + np.diag(free.ravel())
        # Adding the same to all intercepts changes nothing: the shortest step.
        move = -np.linalg.lstsq(hessian, gradient, rcond=1e-13)[0]
        return its | {"objective": objective, "t": 1.0, "base": beta.ravel(), "step": move, "beta": beta.ravel() + move, "moved": float(np.abs(move).max())}

    for _ in range(ITERATIONS):
        state = _summed(rows, state, parts, key, newton, step, _STATE)
        if state.where((F.col("moved") > TOLERANCE) & (F.col("t") > 1e-9)).isEmpty():
            break
    return state.select("cell", "counts", "mean", "std", "base")


def predict_logistic(rows: DataFrame, fits: DataFrame, key: str = "piece_id") -> DataFrame:
    """(cell, key, label, p) for ``rows`` (cell, key, x), in every cell's fit."""
    rows, parts = _dealt(rows.select("cell", key, "x"), key)
    kind = rows.schema[key].dataType.simpleString()

    def run(group, own: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        if own.empty or its.empty:
            return pd.DataFrame({"cell": [], key: [], "label": [], "p": []}, dtype=object)
        fit = its.iloc[0]
        counts = np.array(fit["counts"])
        p = shares_of(_matrix(own, fit["mean"], fit["std"]), np.array(fit["base"]).reshape(len(counts), -1), counts > 0)
        return pd.DataFrame({"cell": group[0], key: np.repeat(own[key].to_numpy(), len(counts)), "label": np.tile(np.arange(len(counts)), len(own)), "p": p.ravel()})

    return rows.groupBy("cell", "part").cogroup(_by_part(fits, parts)).applyInPandas(run, f"cell string, {key} {kind}, label int, p double")
