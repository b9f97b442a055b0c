"""Nested folds and forests grown together, against plain trees of the same draws."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import forests, nested


def draw(*key):
    return int.from_bytes(hashlib.sha256("|".join(map(str, key)).encode()).digest()[:8], "big")


def poisson(*key):
    return sum(draw(*key) / 2.0**64 >= p for p in forests.POISSON)


def gini(c):
    w = sum(c)
    return w, 1 - sum((x / w) ** 2 for x in c)


def plain_tree(bins, y, w, cw, labels, m, least, depth, seed, forest, tree):
    """{node: (feature, bin)} and the function that gives a row's leaf."""
    splits, waiting = {}, [(1, np.flatnonzero(w > 0), 0)]
    while waiting:
        node, at, level = waiting.pop()
        total = np.array([w[at][y[at] == k].sum() for k in range(labels)])
        if level == depth or total.sum() < 2 * least or (total > 0).sum() < 2:
            continue
        best = None
        for f in sorted({draw(seed, forest, tree, node, j) % bins.shape[1] for j in range(m)}):
            for b in sorted(set(bins[at, f])):
                left = np.array([w[at][(y[at] == k) & (bins[at, f] <= b)].sum() for k in range(labels)])
                right = total - left
                if left.sum() < least or right.sum() < least:
                    continue
                (wl, gl), (wr, gr), (wt, gt) = gini(cw * left), gini(cw * right), gini(cw * total)
                gain = round(gt - wl / wt * gl - wr / wt * gr, 12)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, f, b
        if best:
            splits[node] = best[1:]
            goes = bins[at, best[1]] > best[2]
            waiting += [(2 * node, at[~goes], level + 1), (2 * node + 1, at[goes], level + 1)]

    def leaf(x):
        node = 1
        while node in splits:
            f, b = splits[node]
            node = 2 * node + int(x[f] > b)
        return node

    return splits, leaf


def test_forests_are_those_of_plain_trees(spark):
    rng = np.random.default_rng(4)
    n, labels, trees, depth, seed = 90, 3, 3, 4, 5
    y = rng.integers(0, labels, n)
    x = np.round(rng.normal(size=(n, 6)) + y[:, None] * np.array([1, 0.5, 0, 0, 0, 0]), 3)
    vectors = spark.createDataFrame([(int(i), int(y[i]), x[i].tolist()) for i in range(n)], "piece_id long, label int, vector array<double>")
    edges = forests.bin_edges(vectors, "vector", 8)
    plain_edges = [sorted({sorted(x[:, f])[(n - 1) * k // 8] for k in range(1, 8)}) for f in range(6)]
    assert edges == plain_edges
    bins = np.array([[sum(e < v for e in plain_edges[f]) for f, v in enumerate(row)] for row in x])
    ready = vectors.select("piece_id", "label", forests.binned(F.col("vector"), edges).alias("bins"))
    kinds = {"a": (2, 1), "b": (6, 4)}
    train = {"a": np.arange(n) % 3 != 0, "b": np.arange(n) % 4 != 1}
    members = spark.createDataFrame([(k, int(i), bool(train[k][i])) for k in kinds for i in range(n)], "forest string, piece_id long, is_train boolean")
    settings = spark.createDataFrame([(k, *v) for k, v in kinds.items()], "forest string, max_features int, min_leaf int")
    found, splits = forests.forest_predictions(ready.repartition(5), members.repartition(3), settings, labels, 6, trees, depth, seed)
    got, cuts = {(r.forest, r.piece_id, r.label): r.p for r in found.collect()}, {(r.forest, r.tree, r.node): (r.feature, r.bin) for r in splits.collect()}
    want_cuts = {}
    for k, (m, least) in kinds.items():
        counts = Counter(y[train[k]].tolist())
        cw = np.array([train[k].sum() / (len(counts) * counts[c]) if counts[c] else 0.0 for c in range(labels)])
        total = defaultdict(float)
        for t in range(trees):
            w = np.array([poisson(seed, k, t, i) if train[k][i] else 0 for i in range(n)])
            mine, leaf = plain_tree(bins, y, w, cw, labels, m, least, depth, seed, k, t)
            want_cuts |= {(k, t, node): cut for node, cut in mine.items()}
            shares = defaultdict(lambda: np.zeros(labels))
            for i in range(n):
                shares[leaf(bins[i])] += w[i] * cw * (np.arange(labels) == y[i])
            for i in np.flatnonzero(~train[k]):
                of = shares[leaf(bins[i])]
                for c in range(labels):
                    total[k, i, c] += of[c] / of.sum() / trees
        assert all(got[k, int(i), c] == pytest.approx(total[k, i, c], abs=1e-8) for i in np.flatnonzero(~train[k]) for c in range(labels))
    assert cuts == want_cuts and len(cuts) > 12
    again, _ = forests.forest_predictions(ready, members.orderBy(F.desc("piece_id")), settings, labels, 6, trees, depth, seed)
    assert {(r.forest, r.piece_id, r.label): r.p for r in again.collect()} == got


def test_forests_grow_by_units_and_copy_no_vectors(spark, monkeypatch):
    """Chunks and blocks of trees give the same trees as one unit, groups the same as their rows."""
    rng = np.random.default_rng(9)
    n, labels = 120, 3
    y, x = rng.integers(0, labels, n), rng.integers(0, 8, (n, 5))
    ready = spark.createDataFrame([(int(i), f"g{i % 10}", int(y[i]), x[i].tolist()) for i in range(n)], "piece_id long, group_id string, label int, bins array<tinyint>")
    groups = spark.createDataFrame([(f"f{k}", f"g{g}", g % 3 != k) for k in range(3) for g in range(10)], "forest string, group_id string, is_train boolean")
    settings = spark.createDataFrame([(f"f{k}", 3, 1 + k) for k in range(3)], "forest string, max_features int, min_leaf int")
    members = groups.join(ready.select("piece_id", "group_id"), "group_id").select("forest", "piece_id", "is_train")

    def grown(*more):
        found, splits = forests.forest_predictions(ready, groups if more else members, settings, labels, 5, 2, 3, 4, "piece_id", *more)
        return sorted(map(tuple, found.collect())), sorted(map(tuple, splits.collect()))

    want = grown()
    assert len(want[0]) == labels * sum(i % 10 % 3 == k for k in range(3) for i in range(n)) and len(want[1]) > 12
    monkeypatch.setattr(forests, "CHUNK", 30)
    monkeypatch.setattr(forests, "BLOCK", 2)
    assert grown("group_id") == want


def test_nested_folds_hold_groups_whole_and_labels_even(spark):
    rng = np.random.default_rng(6)
    rows = [(g, f"l{g % 3}", int(rng.integers(1, 9))) for g in range(60)] + [(g, f"l{(g + 1) % 3}", 2) for g in range(0, 60, 10)]
    groups = spark.createDataFrame(rows, "group_id int, label string, n long")
    first = sorted(map(tuple, nested.nested_folds(groups, 5, 3, 2).collect()), key=repr)
    assert first == sorted(map(tuple, nested.nested_folds(groups.orderBy(F.desc("n")).repartition(4), 5, 3, 2).collect()), key=repr)
    for repeat in range(2):
        tested = Counter()
        for outer in range(5):
            part = {g: i for r, o, g, i in first if (r, o) == (repeat, outer)}
            assert set(part) == set(range(60)) and {i for i in part.values() if i is not None} == {0, 1, 2}
            tested.update(g for g, i in part.items() if i is None)
            for label in ("l0", "l1", "l2"):
                whole = sum(n for g, lab, n in rows if lab == label)
                held = sum(n for g, lab, n in rows if lab == label and part[g] is None)
                assert abs(held / whole - 0.2) < 0.08
        assert tested == Counter(range(60))


def test_nested_choice_uses_inner_folds_only(spark):
    def rows(inner, setting, right, outer=0):
        return [(0, outer, inner, setting, "a", "a" if k < right else "b") for k in range(4)] + [(0, outer, inner, setting, "b", "b")]

    table = rows(0, 0, 4) + rows(1, 0, 2) + rows(0, 1, 3) + rows(1, 1, 3) + rows(-1, 0, 0) + rows(-1, 1, 4) + rows(0, 0, 2, 1) + rows(0, 1, 3, 1)
    df = spark.createDataFrame(table, "repeat int, outer_fold int, inner_fold int, setting int, true_label string, predicted_label string")
    got = {(r.outer_fold, r.setting, r.inner_score) for r in nested.chosen_settings(df).collect()}
    assert got == {(0, 0, 0.875), (1, 1, 0.875)}
