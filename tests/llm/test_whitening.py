"""Whitening against NumPy's decomposition."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialis.llm import whitening

NAN, INF = float("nan"), float("inf")


def check(rows, out, k):
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    far = n * x - s
    y = far / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    got = out.toPandas()
    assert set(got.n) == {n} and len(got) == n * k and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    want = y @ v / np.sqrt(e)
    deviations = dict(zip([i for i, _ in rows], (far**2).sum(axis=1).tolist()))
    assert (got.deviation == got.vec_id.map(deviations)).all()
    own = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    assert np.abs(own * np.sign((own * want).sum(axis=0)) - want).max() < 1e-9
    shares = got.drop_duplicates("component").sort_values("component").explained
    np.testing.assert_allclose(shares, e / np.trace(y.T @ y / n), rtol=1e-9)


@pytest.mark.parametrize("shape", ["flat", "steep", "shifted"])
def test_equals_eigenvectors(spark, shape):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 24))
    if shape == "steep":
        x = x * 10.0 ** -np.linspace(-2, 1, 24) @ np.linalg.qr(rng.normal(size=(24, 24)))[0]
    if shape == "shifted":
        x = x * np.linspace(3, 1, 24) + 5000
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    check(rows, whitening.whiten(vectors, k=6), 6)


def test_awkward_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [None] * 5), (103, [NAN] * 5), (104, [INF, 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({c: F.lit("mine") for c in ("n", "u", "part", "component", "whitened")})
    check(rows, whitening.whiten(vectors, k=32), 5)
    assert whitening.whiten(vectors.where("vec_id >= 100 and vec_id < 105")).count() == 0
    assert whitening.whiten(vectors.where("vec_id = 3")).count() == 0
    assert whitening.whiten(vectors.where("false")).count() == 0
    twice = whitening.whiten(vectors.where("vec_id < 60").unionByName(vectors.where("vec_id < 60").withColumn("vec_id", F.lit(None).cast("long"))), k=2).toPandas()
    assert set(twice.n) == {120} and twice.vec_id.isna().sum() == 120


def test_directions_without_variance(spark):
    rng = np.random.default_rng(4)
    low = np.round(rng.normal(size=(80, 3)) * 3) @ rng.integers(-2, 3, size=(3, 12))
    out = whitening.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(low)], "vec_id long, embedding array<double>"), k=8)
    assert sorted(r.component for r in out.select("component").distinct().collect()) == [1, 2, 3]
    assert out.agg(F.max("identity_error")).first()[0] < 1e-8


def test_leading_pairs_of_a_plain_matrix():
    """Equal eigenvalues, a cluster at the edge of the wanted ones, and a matrix of zeros."""
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.normal(size=(50, 50)))[0]
    for e in (np.r_[5.0, 5.0, 5.0, np.linspace(1, 0.5, 47)], np.r_[9.0, 1 + 1e-6 * np.arange(49)[::-1]], np.r_[1e6, 10.0, 1.0, np.full(47, 1e-3)]):
        a = turn * e @ turn.T
        values, vectors = whitening.leading(lambda q: a @ q, 50, 3)
        np.testing.assert_allclose(values, np.sort(e)[::-1][:3], rtol=1e-9)
        assert np.abs(a @ vectors - vectors * values).max() < 1e-9 * e.max()
    assert len(whitening.leading(lambda q: 0 * q, 50, 3)[0]) == 0


def test_too_large_components(spark):
    vectors = spark.createDataFrame([(i, [float(i) * 1e15, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large|OverflowError|overflow"):
        whitening.whiten(vectors).collect()
