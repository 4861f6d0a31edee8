"""Group-wise selection and exact quantiles: one group may hold all rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialis.operators import quantiles as Q
from spatialis.operators import sampling as M
from spatialis.operators import selection as S
from spatialis.operators import tokens as T


def order(salt, i):
    return int(hashlib.md5(f"{salt}|{i}".encode()).hexdigest()[:8], 16), i


def rows(spark):
    """A group of nearly all rows, some small ones, one without a name."""
    return spark.range(3000).select(F.col("id").alias("cell_id"), F.when(F.col("id") % 100 == 0, F.lit(None)).when(F.col("id") % 50 == 1, F.concat(F.lit("g"), F.col("id") % 7)).otherwise("all").alias("slice")).repartition(5).cache()


def wanted(df, salt, target):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.slice, []).append(r.cell_id)
    return {i for ids in groups.values() for i in sorted(ids, key=lambda i: order(salt, i))[: target(len(ids))]}


@pytest.mark.parametrize("bucket", [1, 16, 4096])
def test_samples_of_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    df = rows(spark)
    ids = lambda out: {r.cell_id for r in out.collect()}
    assert ids(M.sample_cells(df, "slice", 40)) == wanted(df, "cells", lambda n: min(n, 40))
    assert ids(M.sample_ratio(df, "slice", 0.07)) == wanted(df, "cells", lambda n: int(n * 0.07))
    split = M.split_by_slice(df, "slice", 0.1)
    assert split.count() == 3000 and ids(split.where("split = 'valid'")) == wanted(df, "split", lambda n: max(1, int(n * 0.1)))
    assert ids(M.subsample_fix(df, "slice", 30, {"all": 2.0})) == {i for i in wanted(df, "subsample", lambda n: 60 if n > 1000 else min(n, 30))}
    assert M.sample_cells(df.where("false"), "slice", 3).count() == 0 and M.sample_cells(df, "slice", 0).count() == 0


def test_only_one_bucket_of_a_group_is_ranked(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 64)
    df = rows(spark)
    sizes = S.group_sizes(df, ["slice"]).withColumn("target", F.floor(F.col("n") / 3))
    ranked = S._placed(df, ["slice"], sizes, "cells", "cell_id").where("_bucket = _end.at").groupBy("slice").count().collect()
    assert max(r["count"] for r in ranked) < 130


def test_chunks_of_one_batch(spark):
    df = rows(spark)
    got = {}
    for r in T.assign_batches(df, "slice", 16).collect():
        got.setdefault(r.slice, []).append((r.cell_id, r.chunk))
    assert {g: sorted(x) for g, x in got.items()} == {g: [(i, n // 16) for n, i in enumerate(sorted(i for i, _ in x))] for g, x in got.items()} and sum(map(len, got.values())) == 3000


@pytest.mark.parametrize(("small", "bins"), [(4096, 256), (8, 4)])
def test_quantiles_of_uneven_groups(spark, monkeypatch, small, bins):
    monkeypatch.setattr(Q, "SMALL", small)
    monkeypatch.setattr(Q, "BINS", bins)
    rng = np.random.default_rng(9)
    groups = {1: rng.normal(size=9000).round(3), 2: np.r_[np.zeros(500), rng.lognormal(0, 9, 400)], 3: np.array([4.0]), 4: np.r_[np.full(60, -2.5), 1e9, -1e9], 5: np.full(40, 7.0)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [(1, None), (1, float("nan")), (None, 5.0)], "g int, v double").repartition(4).cache()
    shares = (0.0, 0.2, 0.5, 0.77, 1.0)
    got = {r.g: r.q for r in Q.quantiles(df, "g", "v", shares).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        np.testing.assert_allclose(got[g], np.quantile(x, shares), rtol=1e-12, atol=1e-12)
    assert Q.quantiles(df.where("g > 9"), "g", "v", shares).count() == 0
