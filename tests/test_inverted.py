"""Approximate neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialis.operators import inverted as I
from spatialis.operators import transfer as L
from spatialis.sources.standins import standin
from tests.conftest import SF

SCHEMA = "vec_id long, label int, embedding array<double>"


def recall(got, ref, asked, k):
    x = np.array([e for _, _, e in ref])
    ids = np.array([i for i, _, _ in ref])
    hit = 0
    for i, _, e in asked:
        d = np.round(np.sqrt(((x - e) ** 2).sum(axis=1)), 9)
        hit += len(set(ids[np.lexsort((ids, d))[:k]].tolist()) & got.get(i, set()))
    return hit / (min(k, len(ref)) * len(asked))


def neighbours(out):
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return got


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_recall_of_clustered_and_even_vectors(spark, monkeypatch, spread):
    monkeypatch.setattr(I, "SAMPLE", 2048)
    monkeypatch.setattr(I, "ROWS", 64)
    monkeypatch.setattr(I, "QUERIES", 32)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 6000)] + spread * rng.normal(size=(6000, 32))
    ref = [(i, i % 3, v.tolist()) for i, v in enumerate(x[:5800])]
    asked = [(i, 0, v.tolist()) for i, v in enumerate(x[5800:], 10_000)]
    out = I.approximate_neighbours(spark.createDataFrame(ref, SCHEMA).repartition(4), spark.createDataFrame(asked, SCHEMA), 10)
    assert out.groupBy("query_id").count().where("count <> 10").count() == 0
    assert recall(neighbours(out), ref, asked, 10) >= 0.9


def test_recall_of_the_given_vectors(spark):
    vec = standin(spark, SF, "vec").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"), "role").where("embedding is not null").cache()
    ref, asked = ([tuple(r)[:3] for r in vec.where(F.col("role") == role).collect()] for role in ("ref", "query"))
    assert recall(neighbours(I.approximate_neighbours(vec.where("role = 'ref'"), vec.where("role = 'query'"), 10)), ref, asked, 10) >= 0.9


def test_few_equal_and_missing_rows(spark):
    rows = [(i, i % 2, [1.0, 2.0, 3.0]) for i in range(300)] + [(900, 1, None), (901, 1, [9.0, 9.0, 9.0])]
    asked = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0]), (2, 0, [9.0, 9.0, 8.0]), (3, 0, None)], SCHEMA)
    ref = spark.createDataFrame(rows, SCHEMA)
    assert neighbours(I.approximate_neighbours(ref, asked, 4)) == {1: {0, 1, 2, 3}, 2: {901, 0, 1, 2}}
    assert neighbours(I.approximate_neighbours(ref.where("vec_id < 2"), asked, 4)) == {1: {0, 1}, 2: {0, 1}}
    assert I.approximate_neighbours(ref.where("false"), asked, 4).count() == 0 and I.approximate_neighbours(ref, asked.where("false"), 4).count() == 0
    assert {r.query_id: r.pred for r in L.ann_vote(ref, asked, 3).collect()} == {1: 0, 2: 1}
