"""Whitening and near duplicates of embeddings, against numpy on all pairs."""

import math

import numpy as np
import pytest

from tessitura.llm import vector_near_dups as near
from tessitura.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, node long, x int, copies int, hash int, component int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 3, 7, 7, 7, 7, 7) for i, v in rows], schema)


AWKWARD = [(900, None), (901, []), (902, [0.1] * 7 + [None]), (903, [0.1] * 7 + [math.nan]), (904, [0.1] * 7 + [math.inf]), (905, [1.0, 2.0])]


def vectors(n, dims, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    return (rng.normal(0, spread, (n, dims)) * np.linspace(1, 2, dims)).astype(np.float32)


def plain_whitening(rows, most=16):
    x = {k: np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000 for k, v in enumerate(v for _, v in rows)}
    every = np.array(list(x.values()))
    fit = np.unique(every, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = fit - sums / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1], axes[:, ::-1]
    kept = min(most, int((e > 1e-9 * e[0]).sum()))
    return n, ((n * every - sums) ** 2).sum(1), (every - sums / n) @ axes[:, :kept] / np.sqrt(e[:kept]), e[:kept] / e.sum()


@pytest.mark.parametrize(("n", "dims"), [(120, 8), (60, 20), (5, 8)])
def test_whitening_is_that_of_numpy(spark, n, dims):
    v = vectors(n, dims, n)
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(3, v[3].tolist()), (None, v[4].tolist()), (700, v[3].tolist())]
    got = whitening.whiten(frame(spark, rows + [a if a[1] is None else (a[0], (a[1] * dims)[: max(len(a[1]), 0)]) for a in AWKWARD]).repartition(5)).collect()
    count, deviation, want, explained = plain_whitening(rows)
    kept = want.shape[1]
    assert len(got) == kept * len(rows) and {r.n for r in got} == {count}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = np.sign([by[0, k + 1][0].whitened * want[0, k] for k in range(kept)])
    for place, (i, _) in enumerate(rows):
        for k in range(kept):
            for r in by[i, k + 1]:
                assert r.whitened * signs[k] == pytest.approx(want[place, k], abs=1e-8) and r.deviation == deviation[place]
                assert r.explained == pytest.approx(explained[k], rel=1e-9) and r.identity_error < 1e-9
    assert len(by[3, 1]) == 2 and len(by[None, 1]) == 1


def test_whitening_of_few_or_equal_vectors(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, AWKWARD[:5])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    line = whitening.whiten(frame(spark, [(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0]), (3, [3.0, 6.0, 0.0]), (4, [3.0, 6.0, 0.0])])).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9)) for r in line) == [(1, 1, 1.224744871), (2, 1, 0.0), (3, 1, 1.224744871), (4, 1, 1.224744871)]
    assert {r.explained for r in line} == {1.0}


def test_deviations_stay_exact_and_null_beyond_a_long(spark):
    schema = SCHEMA.replace("array<float>", "array<double>")
    rows = [(1, [float(2**40), 1.0]), (2, [-float(2**40), 2.0]), (3, [0.0, 5.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, rows, schema)).where("component = 1").collect()}
    assert got == {1: None, 2: None, 3: (3 * 320 - 512) ** 2}


def plain_links(rows):
    """(n_links, component) by place, over all pairs."""
    fine = [v is not None and len(v) > 0 and all(e is not None and math.isfinite(e) for e in v) and any(v) for _, v in rows]
    unit = {k: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for k, (_, v) in enumerate(rows) if fine[k]}
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    return links, [min((i for i in ids[find(k)] if i is not None), default=None) for k in range(len(rows))]


def near_copies(n, dims, groups, size, noise, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    rows = list(base)
    for g in range(groups):
        c = base[g] / np.linalg.norm(base[g])
        rows += [c + noise * rng.normal(size=dims) / math.sqrt(dims) for _ in range(size)]
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rows)]


def agree(spark, rows, least=1.0, **options):
    got = near.vector_near_duplicates(frame(spark, rows).repartition(3), **options).collect()
    links, ids = plain_links(rows)
    assert len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    if least == 1.0:
        want = sorted(map(repr, zip((i for i, _ in rows), links, ids, strict=True)))
        assert sorted(map(repr, ((r.vec_id, r.n_links, r.component_id) for r in got))) == want
        return
    found = {r.vec_id: r.n_links for r in got}
    assert all(found[i] <= k for (i, _), k in zip(rows, links, strict=True)) and sum(found.values()) >= least * sum(links)


def test_vector_links_are_those_of_all_pairs_within_few_leaves(spark):
    rows = near_copies(80, 16, 6, 8, 0.25)
    copies = [(1000 + k, rows[k % 3][1]) for k in range(40)] + [(None, rows[0][1]), (5, rows[7][1]), (None, rows[90][1])]
    agree(spark, rows + copies + AWKWARD + [(910, [0.0] * 16), (911, [0.0] * 16), (912, [2 * x for x in rows[1][1]])])
    assert near.vector_near_duplicates(frame(spark, [])).collect() == []
    assert {r.n_links for r in near.vector_near_duplicates(frame(spark, AWKWARD[:5])).collect()} == {0}


def test_deep_trees_small_samples_and_blocks_lose_few_links(spark, monkeypatch):
    rows = near_copies(600, 24, 40, 5, 0.25)
    agree(spark, rows, 0.95, leaf=40)
    agree(spark, rows, 0.9, leaf=40, sample=120)
    monkeypatch.setattr(near, "BLOCK", 50)
    agree(spark, rows, 1.0, leaf=2000)


def test_a_dense_group_is_a_ball_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 30)
    rows = near_copies(150, 16, 1, 120, 0.12) + [(2000 + i, v) for i, v in enumerate(v for _, v in near_copies(2, 16, 2, 60, 0.35, 9))]
    v = np.array([x for _, x in rows])
    forest = near.fit_forest(v, len(v))
    ball, reach = forest.places(near._units(v))
    assert len(forest.balls) and (ball >= 0).sum() > 100 and any(reach)
    agree(spark, rows)


def test_links_at_the_threshold_are_never_below_it(spark):
    angles = np.arccos([0.9499999, 0.9500001, 0.95 + 1e-6, 0.94])
    rows = [(0, [1.0, 0.0])] + [(k + 1, [math.cos(a), math.sin(a) * (-1) ** k]) for k, a in enumerate(angles)]
    schema = SCHEMA.replace("array<float>", "array<double>")
    got = near.vector_near_duplicates(frame(spark, rows, schema)).collect()
    links, ids = plain_links(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(zip(range(5), links, ids, strict=True))
