"""Draws, transport and centroids against cases worked out apart from Spark."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from spatialis.operators import jobs as J
from spatialis.operators import perturb as X

def drawn(*keys, salt):
    return int(hashlib.md5("|".join(map(str, (salt, *keys))).encode()).hexdigest()[:8], 16) / 4294967296.0


def test_every_donor_can_be_drawn(spark):
    kinds = F.when(F.col("id") % 5 < 4, "t").otherwise("u")
    donors = spark.range(3000).select(F.col("id").alias("cell_id"), kinds.alias("cell_type"))
    cells = spark.range(5000, 9000).select(F.col("id").alias("cell_id"), F.lit("t").alias("cell_type"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))
    order = sorted((i for i in range(3000) if i % 5 < 4), key=lambda i: (drawn(i, salt="replace-order"), i))
    got = {r.cell_id: r.donor_id for r in X.inject_replace(cells, "t", donors).collect()}
    assert got == {i: order[int(drawn(i, salt="replace") * len(order))] for i in range(5000, 9000)}
    assert len(set(got.values())) > 1000
    order = sorted(range(3000), key=lambda i: (drawn(i, salt="inject-order"), i))
    names = {r.cell_name for r in X.inject_random(cells, donors, 7).where("injected").collect()}
    assert names == {f"{order[int(drawn(i, salt='inject-donor') * 3000)]}_inj{i}" for i in range(7)}


def test_centroids_of_unit_vectors(spark):
    """Long vectors count no more than short ones."""
    vectors = spark.createDataFrame([(1, [10.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [0.0, 0.0], "a")], "vec_id long, embedding array<double>, label string")
    center = X.unit_centroid(vectors.where("vec_id < 3"))
    assert np.allclose(center.first().centroid, [0.5**0.5, 0.5**0.5])
    out = {r.vec_id: r.delta for r in X.delta_cosine(vectors, center, vectors.where("vec_id = 1"), "label").collect()}
    assert abs(out[1]) < 1e-12 and abs(out[2]) < 1e-12 and out[3] is None
    both = {r.vec_id: (r.cos_young, r.cos_old) for r in X.centroid_coords(vectors, center, X.unit_centroid(vectors.where("vec_id = 2"))).collect()}
    assert np.allclose(both[1], [0.5**0.5, 0.0]) and np.allclose(both[2], [0.5**0.5, 1.0])


def test_niche_targets_are_drawn_from_all(spark):
    cells = spark.range(50).select(F.col("id").alias("cell_id"), F.lit(1).alias("slice"), F.lit("t").alias("cell_type"), (F.col("id") * 100.0).alias("x"), F.lit(0.0).alias("y"))
    donors = spark.range(100, 400).select(F.col("id").alias("cell_id"), F.lit("u").alias("cell_type"))
    out = J.inject_niche(cells, donors, 200, spread=0.0).collect()
    new = [r for r in out if r.injected]
    assert len(new) == 200 == len({r.cell_name for r in new}) and len(out) == 250
    assert {r.x for r in new} <= {100.0 * i for i in range(50)} and len({r.x for r in new}) > 25


def test_transport_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    y, o = 0.4 * rng.normal(size=(13, 4)), 0.4 * rng.normal(size=(9, 4)) + 0.2
    sets = [y, o, o + 0.2 * rng.normal(size=(9, 4))]
    tables = [spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(s)], "vec_id long, embedding array<double>") for s in sets]
    got = {r.vec_id: r for r in J.shift_ot(*tables, block=5).collect()}
    cos, dist = [], []
    for t in sets[1:]:
        k = np.exp(-((y[:, None] - t[None]) ** 2).sum(2))
        v = np.ones(9)
        for _ in range(1000):
            u = (1 / 13 / (k @ v)) ** (10 / 11)
            v = (1 / 9 / (k.T @ u)) ** (10 / 11)
        plan = u[:, None] * k
        p = (plan / plan.sum(0)).T @ y
        cos.append((t * p).sum(1) / np.linalg.norm(t, axis=1) / np.linalg.norm(p, axis=1))
        dist.append(np.linalg.norm(t - p, axis=1))
    assert np.allclose([[got[i].cos_before, got[i].cos_after, got[i].cos_change] for i in range(9)], np.array([*cos, cos[1] - cos[0]]).T, atol=1e-6)
    assert np.allclose([[got[i].dist_before, got[i].dist_after, got[i].dist_change] for i in range(9)], np.array([*dist, dist[1] - dist[0]]).T, atol=1e-6)
