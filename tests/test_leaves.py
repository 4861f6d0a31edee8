"""Neighbours, pairs and densities over the leaves of k-d trees against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialis.operators import leaves as L
from spatialis.operators import spatial as S
from tests.test_edges import cells


def points_of(case):
    rng = np.random.default_rng(7)
    if case == "even":
        return [(i % 2, *rng.integers(0, 40, 2)) for i in range(500)]
    if case == "clump":
        return [(0, *(100 + rng.random(2) * 1e-4)) for _ in range(300)] + [(0, *(rng.random(2) * 1e4)) for _ in range(100)] + [(0, 1e9, 1e9), (1, 3, 3)]
    if case == "crowd":
        return [(0, 7, 7)] * 400 + [(0, 7, i) for i in range(60)] + [(1, 3, 3)] * 20 + [(2, i, 0) for i in range(5)]
    return [(0, i, 0) for i in range(300)]


@pytest.mark.parametrize("case", ["even", "clump", "crowd", "line"])
@pytest.mark.parametrize("leaf", [24, 8192])
def test_searches_equal_brute_force(spark, case, leaf):
    points = points_of(case)
    df = cells(spark, points).repartition(3).cache()
    p = np.array(points, float)
    d2 = np.where(p[:, None, 0] == p[None, :, 0], (p[:, None, 1] - p[None, :, 1]) ** 2 + (p[:, None, 2] - p[None, :, 2]) ** 2, np.inf)
    for k in (1, 7):
        want = set()
        for i in range(len(points)):
            order = [j for j in np.argsort(d2[i], kind="stable")[:k] if d2[i, j] < np.inf]
            want |= {(i, int(j), n, float(d2[i, j])) for n, j in enumerate(order, 1)}
        assert {(r.cell_id, r.nbr_id, r["rank"], r.dist2) for r in S.knn_in_group(df, k, ["slice"], leaf).collect()} == want
    for radius in (5.0, 60.0):
        want = {i: int((d2[i] <= radius**2).sum()) for i in range(len(points))}
        assert {r.cell_id: r.density for r in S.density_token(df, radius, leaf=leaf).collect()} == want


def test_groups_of_several_columns_and_missing_values(spark):
    rows = [(i, "a" if i % 2 else None, i % 3, float(i % 17), float(i % 23) if i % 29 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "cell_id int, slice string, part int, x double, y double")
    for leaf in (20, 8192):
        got = {}
        for r in S.knn_in_group(df, 3, ["slice", "part"], leaf).collect():
            got.setdefault((r.slice, r.part, r.cell_id), []).append((r["rank"], r.nbr_id))
        own = [r for r in rows if r[1] and r[4] is not None]
        assert set(got) == {(s, p, i) for i, s, p, _, _ in own}
        for i, s, p, x, y in own:
            near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, t, q, a, b in own if (t, q) == (s, p))[:3]
            assert sorted(got[s, p, i]) == [(n, j) for n, (_, j) in enumerate(near, 1)]
    odd = spark.createDataFrame([(1, 0, float("nan"), 1.0), (2, 0, float("inf"), 1.0), (3, 0, 1.0, 1.0), (4, None, 1.0, 1.0)], "cell_id long, slice long, x double, y double")
    assert [(r.cell_id, r.nbr_id) for r in S.knn_in_group(odd, 2, ["slice"]).collect()] == [(3, 3)] and [(r.cell_id, r.density) for r in S.density_token(odd, 9).collect()] == [(3, 1)]
    assert S.knn_in_group(df.where("false"), 3, ["slice"]).count() == 0 and S.density_token(df.where("false"), 3).count() == 0


def test_hot_squares_are_parted(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 50)
    points = [(0, i % 20, i % 7) for i in range(300)] + [(0, 500, 500)]
    p = np.array(points, float)
    near = (p[:, None, 1] - p[None, :, 1]) ** 2 + (p[:, None, 2] - p[None, :, 2]) ** 2 <= 100
    got = [(r.cell_id, r.nbr_id) for r in S.radius_pairs(cells(spark, points), 10, ["slice"]).collect()]
    assert len(got) == len(set(got)) == near.sum() and set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


def test_rows_of_a_clump_grow_with_its_places(spark, monkeypatch):
    """10,000 and 20,000 different places within one radius: no rows for pairs, in leaves of one or more."""
    made = []
    staged = S.staged
    monkeypatch.setattr(S, "staged", lambda df, name: made.append(staged(df, name)) or made[-1])
    rng = np.random.default_rng(1)
    for leaf in (2_000, 8192, 50_000):
        sizes = []
        for n in (10_000, 20_000):
            made.clear()
            df = spark.createDataFrame([(i, 0, float(x), float(y)) for i, (x, y) in enumerate(rng.random((n, 2)))], "cell_id long, slice long, x double, y double")
            assert S.density_token(df, 2.0, leaf=leaf).agg(F.min("density"), F.max("density")).first() == (n, n)
            sizes.append(sum(t.count() for t in made))
        assert sizes[0] <= 4 * 10_000 and sizes[1] <= 2.1 * sizes[0]


def test_a_tree_deals_places_evenly():
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.random((40_000, 2)) * 1e-3, rng.random((20_000, 2)) * 1e3])
    tree = L.Tree.of(xy[rng.random(len(xy)) < 0.1], len(xy), 2_000)
    at = tree.leaf_of(xy)
    assert np.bincount(at, minlength=len(tree.boxes)).max() < 4_000
    boxes = np.array(tree.boxes)[at]
    assert ((xy >= boxes[:, :2]) & (xy <= boxes[:, 2:])).all()
    same = L.Tree.of(np.ones((500, 2)), 10**6, 100)
    assert len(same.boxes) == 1
