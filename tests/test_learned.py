"""What is learned, on data whose answer is known: regression, transfer by every method, clusterings, scores."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialis.operators import jobs as J
from spatialis.operators import metrics as E
from spatialis.operators import transfer as L

SCHEMA = "vec_id long, label int, embedding array<double>"


def clouds(spark, n, first=0, seed=3, far=8.0):
    """Three clouds of points around corners."""
    rng = np.random.default_rng(seed)
    corners = np.eye(3, 6) * far + 1
    return spark.createDataFrame([(first + i, i % 3, (corners[i % 3] + rng.normal(size=6)).tolist()) for i in range(n)], SCHEMA)


@pytest.mark.parametrize("method", ["native", "flat", "ann", "prototype", "logreg"])
def test_every_method_transfers_clear_labels(spark, method):
    ref, asked = clouds(spark, 240), clouds(spark, 60, 1000, seed=4)
    got = L.label_transfer(ref, asked, method, k=15).join(asked.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    assert got.count() == 60 and got.where("pred = label").count() == 60
    with pytest.raises(ValueError, match="unknown method"):
        L.label_transfer(ref, asked, "other")


def test_regression_beats_chance_on_overlapping_clouds(spark):
    """Against the best linear answer, which the clouds' corners give."""
    ref, asked = clouds(spark, 900, far=2.0), clouds(spark, 300, 5000, seed=9, far=2.0)
    got = {r.query_id: r.pred for r in L.logreg(ref, asked).collect()}
    rows = asked.collect()
    ideal = np.mean([int(np.argmax(r.embedding[:3])) == r.label for r in rows])
    assert np.mean([got[r.vec_id] == r.label for r in rows]) > ideal - 0.04 > 0.8


def test_nearest_centroid_by_both_measures(spark):
    ref, asked = clouds(spark, 90), clouds(spark, 30, 1000, seed=5, far=1.0)
    centers = {r.label: np.array(r.centroid) for r in L.centroids(ref, ["label"]).collect()}
    for metric in ("euclidean", "cosine"):
        got = {r.query_id: r.pred for r in L.nearest_centroid(L.centroids(ref, ["label"]), asked, metric).collect()}
        for r in asked.collect():
            e = np.array(r.embedding)
            score = {k: -((e - c) ** 2).sum() if metric == "euclidean" else e @ c / np.linalg.norm(e) / np.linalg.norm(c) for k, c in centers.items()}
            assert got[r.vec_id] == max(score, key=score.get)
    zero = spark.createDataFrame([(1, 0, [0.0] * 6)], SCHEMA)
    assert L.nearest_centroid(L.centroids(ref, ["label"]), zero, "cosine").first().pred == 0


def test_sweep_finds_planted_clusters(spark):
    rows = {r.k: r for r in J.cluster_sweep(clouds(spark, 150), [2, 3]).collect()}
    assert np.isclose(rows[3].ari, 1) and np.isclose(rows[3].nmi, 1) and rows[2].ari < 0.8
    with pytest.raises(ValueError, match="no settings"):
        J.cluster_sweep(clouds(spark, 9), [])


def test_scores_by_the_name_of_the_task(spark):
    rng = np.random.default_rng(1)
    true, pred = rng.random((6, 5)) + 0.1, rng.random((6, 5)) + 0.1
    entries = lambda m: spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "cell_id long, gene_id long, value double")
    got = J.downstream_eval("imputation", pred=entries(pred), true=entries(true)).first()
    corr = np.mean([np.corrcoef(pred[:, j], true[:, j])[0, 1] for j in range(5)])
    assert np.isclose(got.mse, ((pred - true) ** 2).mean()) and np.isclose(got["corr"], corr)
    pairs = spark.createDataFrame(list(zip(pred.ravel().tolist(), true.ravel().tolist())), "pred double, true double")
    got = J.downstream_eval("denoising", pairs=pairs).first()
    assert np.isclose(got.rmse, np.sqrt(((pred - true) ** 2).mean())) and np.isclose(got["corr"], np.corrcoef(pred.ravel(), true.ravel())[0, 1])
    said = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (1, 1)], "truth int, pred int")
    assert J.downstream_eval("annotation", df=said).first().accuracy == E.class_metrics(said).first().accuracy == 0.75
