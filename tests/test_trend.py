"""The local trend of variances against NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from spatialis.operators import normalize as N


def by_hand(x, y, span=0.3, grid=64):
    n = len(x)
    q = min(n, max(3, int(n * span + 1e-5)))

    def at(g, where):
        d = np.abs(x - g)
        h = np.sort(d)[q - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        c = np.linalg.lstsq(np.sqrt(w)[:, None] * np.vander(x - g, 3), np.sqrt(w) * y, rcond=None)[0]
        return np.polyval(c, where - g)

    places = x.min() + np.ptp(x) * np.arange(grid) / (grid - 1)
    j = np.clip(np.searchsorted(places, x, "right") - 1, 0, len(places) - 2)
    t = (x - places[j]) / (places[j + 1] - places[j])
    return np.array([(1 - s) * at(places[i], v) + s * at(places[i + 1], v) for i, s, v in zip(j, t, x)])


@pytest.mark.parametrize("n", [40, 700])
def test_trend_equals_local_fits(spark, n):
    rng = np.random.default_rng(n)
    x = np.sort(rng.gamma(2, 1, n))
    y = np.sin(2 * x) + 0.3 * rng.normal(size=n)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "gene_id long, x double, y double").repartition(3)
    got = {r.gene_id: r.fit for r in N.local_trend(df).collect()}
    np.testing.assert_allclose([got[i] for i in range(n)], by_hand(x, y), rtol=1e-7, atol=1e-8)
    if n > 100:
        # The bends are followed, which one quadratic over all doesn't do.
        assert np.mean((np.array([got[i] for i in range(n)]) - np.sin(2 * x)) ** 2) < 0.3 * np.mean((np.polyval(np.polyfit(x, y, 2), x) - np.sin(2 * x)) ** 2)


def test_few_and_equal_points(spark):
    fit = lambda rows: [r.fit for r in N.local_trend(spark.createDataFrame(rows, "x double, y double")).collect()]
    assert fit([]) == [] and fit([(1.0, 4.0)]) == [4.0]
    assert np.allclose(fit([(1.0, 4.0), (1.0, 6.0)]), 5.0)
    assert all(np.isfinite(fit([(1.0, 4.0), (2.0, 6.0)]))) and all(np.isfinite(fit([(1.0, 4.0)] * 9 + [(2.0, 6.0)])))
