"""Variants of operators that no SQL covers, and skewed groups, against plain NumPy."""

from __future__ import annotations

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spatialis.operators import jobs as J
from spatialis.operators import metrics as E
from spatialis.operators import perturb as X
from spatialis.operators import qc as Q
from spatialis.operators import spatial as S
from spatialis.operators import transfer as L
from spatialis.operators import vectors as V
from spatialis.operators.running import running_sums
from spatialis.sources import tables


def vectors(spark, rows, **columns):
    names = ["vec_id", "embedding", *columns]
    data = [(i, [float(x) for x in r], *[c[i] for c in columns.values()]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, names)


def entries(spark, matrix):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(matrix) if v], "cell_id long, gene_id long, value double")


def test_sums_of_one_large_group_run_over_several_ranges(spark):
    rows = spark.range(5000).select(F.lit("all").alias("g"), (F.col("id") * 3).alias("v"), (F.col("id") % 7).alias("k"))
    got = running_sums(rows, ["g"], "v", "k").orderBy("v").collect()
    before = np.concatenate([[0], np.cumsum(np.arange(5000) % 7)[:-1]])
    assert [r.before_k for r in got] == before.tolist()
    assert [r.following for r in got] == [*range(3, 15000, 3), None]


@pytest.mark.parametrize("values", [np.arange(1000) % 10, np.zeros(1000), np.array([5.0])])
def test_quantiles_of_one_gene(spark, values):
    rows = spark.createDataFrame([(1, float(v)) for v in values], "gene_id long, v double")
    got = S.quantile_edges(rows, "gene_id", "v", (0.2, 0.4, 0.5, 0.8)).first().q
    assert np.allclose(got, np.quantile(values, [0.2, 0.4, 0.5, 0.8]), atol=1e-6)
    assert S.quantile_edges(rows.limit(0), "gene_id", "v", (0.5,)).count() == 0


def brute_shift(y, b, a):
    def emd(u, v):
        out = []
        for i in range(u.shape[1]):
            at = np.unique(np.concatenate([u[:, i], v[:, i]]))
            share = lambda w: np.searchsorted(np.sort(w[:, i]), at, "right") / len(w)
            out.append((np.abs(share(u) - share(v))[:-1] * np.diff(at)).sum())
        return np.mean(out)

    k = lambda u, v: np.exp(-((u[:, None] - v[None]) ** 2).sum(2)).mean()
    c = y.mean(0)
    one = lambda o: ((o @ c / np.linalg.norm(o, axis=1) / np.linalg.norm(c)).mean(), np.linalg.norm(o - c, axis=1).mean(), emd(o, y), k(o, o) + k(y, y) - 2 * k(o, y))
    return one(b), one(a)


@pytest.mark.parametrize("niche", [False, True])
def test_shift_of_a_type_and_of_its_niche(spark, niche):
    rng = np.random.default_rng(5)
    x, label, age = rng.normal(size=(60, 3)), [i % 3 for i in range(60)], ["young" if i % 2 else "old" for i in range(60)]
    x[7] = x[9] = x[11]
    after = x + 0.3
    mine = np.array([(v == 1) != niche for v in label])
    young = np.array(age) == "young"
    got = J.shift_to_young(vectors(spark, x, label=label, slice=age), vectors(spark, after, label=label, slice=age), "young", "old", 1, niche).first()
    want = brute_shift(x[mine & young], x[mine & ~young], after[mine & ~young])
    for side, values in zip(("before", "after"), want):
        assert np.allclose([got[f"{c}_{side}"] for c in ("cos", "dist", "emd", "mmd")], values)
    assert np.isclose(got.emd_change, want[1][2] - want[0][2])
    with pytest.raises(ValueError):
        J.shift_to_young(vectors(spark, x, label=label, slice=age), vectors(spark, after, label=label, slice=age), "none", "old", 1)


def test_covariances_and_components(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(40, 4)) + 100, rng.normal(size=(25, 4)) * 2
    got = E.coral(vectors(spark, a).repartition(5), vectors(spark, b)).first().coral
    assert np.isclose(got, ((np.cov(a.T) - np.cov(b.T)) ** 2).mean())
    z = (a - a.mean(0)) / a.std(0, ddof=1)
    pc = np.array([r.pc for r in L.scale_pca(vectors(spark, a), 2).orderBy("vec_id").collect()])
    axes = np.linalg.svd(z - z.mean(0))[2][:2]
    assert np.allclose(np.abs(pc), np.abs(z @ axes.T))


def test_denoising_scores(spark):
    rng = np.random.default_rng(7)
    true, pred = (rng.integers(1, 9, size=(6, 5)).astype(float) for _ in range(2))
    true[0, 1] = pred[2, 2] = 0
    norm = lambda m: np.log1p(m / m.sum(1, keepdims=True) * 1e4)
    t, p = norm(true), norm(pred)
    rows = [np.corrcoef(u, v)[0, 1] for u, v in zip(t, p)]
    got = E.denoise_matrices(entries(spark, pred), entries(spark, true)).first()
    cos = (t * p).sum(1) / np.linalg.norm(t, axis=1) / np.linalg.norm(p, axis=1)
    assert np.allclose([got.mse, got.rmse, got.mae, got.corr, got.cosine], [((t - p) ** 2).mean(), ((t - p) ** 2).mean() ** 0.5, np.abs(t - p).mean(), np.mean(rows), cos.mean()])
    mask = spark.createDataFrame([(i, j) for i in range(6) for j in range(5) if (i + j) % 2], "cell_id long, gene_id long")
    hit = np.add.outer(np.arange(6), np.arange(5)) % 2 == 1
    got = E.denoise_matrices(entries(spark, pred), entries(spark, true), mask).first()
    assert np.allclose([got.mse, got.corr], [((t - p)[hit] ** 2).mean(), np.corrcoef(t[hit], p[hit])[0, 1]])
    log = [np.corrcoef(np.log1p(u), np.log1p(v))[0, 1] for u, v in zip(true, pred)]
    assert np.isclose(E.pearson_rows(entries(spark, pred), entries(spark, true), log=True).first().pearson, np.mean(log))


def test_approximate_votes_leave_no_query_out(spark):
    """Queries far from everything are answered by the exact search."""
    x = np.concatenate([np.zeros((20, 2)), np.full((20, 2), 50.0), [[25.0, 24.0]]])
    ref = vectors(spark, x[:40], label=[0] * 20 + [1] * 20)
    asked = spark.createDataFrame([(7, [24.0, 23.0], 0), (8, [50.0, 50.0], 0)], "vec_id long, embedding array<double>, label int")
    got = {r.query_id: r.pred for r in L.ann_vote(ref, asked, 3).collect()}
    assert got == {7: 0, 8: 1}


def test_small_variants(spark):
    rows = spark.createDataFrame([(1, [5, 6, 5], [False, False, True])], "cell_id long, X array<long>, a array<boolean>")
    assert X.delete_tokens(rows, [6], attention="a").first()[1:] == ([5, 1, 5], [False, True, True])
    matrix = np.array([[1.0, 0.0, 2.0], [0.0, 3.0, 0.0]])
    got = V.projected(spark.createDataFrame([(4, [1.0, 2.0])], "gene_id long, embedding array<double>"), matrix).first()
    assert got.gene_id == 4 and got.embedding == [1.0, 6.0, 2.0]
    genes = spark.createDataFrame([(4, 1, 2), (5, 1, 2)], "gene_id long, homo_connect_id long, gene_type_id long")
    part = lambda key, keys, v: spark.createDataFrame([(k, v) for k in keys], f"{key} long, embedding array<double>")
    own = V.combine_gene_vectors(genes, part("gene_id", [4, 5], [1.0, 1.0]), part("homo_connect_id", [1], [2.0, 0.0]), part("gene_type_id", [2], [0.0, 4.0]), part("gene_id", [5], [10.0, 10.0]))
    assert {r.gene_id: r.embedding for r in own.collect()} == {4: [3.0, 5.0], 5: [13.0, 15.0]}
    values = entries(spark, np.eye(3) * 2)
    with pytest.raises(ValueError):
        Q.filter_vocab(values, spark.createDataFrame([(9,)], "gene_id long"))
    with pytest.raises(ValueError):
        Q.check_covariates(["batch", "age"])
    means = spark.createDataFrame([("STEREO", False, 1, 2.0), ("STEREO", True, 1, 3.0), ("XENIUM", False, 1, 4.0)], "assay string, metacell boolean, gene_id long, mean double")
    read = lambda assay, metacell: [r["mean"] for r in tables.read_gene_mean(means, assay, metacell).collect()]
    assert (read("snrna", True), read("stereo", False), read("xenium", True)) == ([3.0], [2.0], [4.0])


def test_token_tables_have_small_row_groups(spark, tmp_path):
    arrays = {c: F.array(F.col("id")) for c in tables.REQUIRED[1:]}
    rows = spark.range(3000).select(F.col("id").alias("cell_id"), *[v.alias(k) for k, v in arrays.items()])
    tables.write_tokens(rows.coalesce(1), str(tmp_path / "t"))
    file = pq.ParquetFile(glob.glob(str(tmp_path / "t" / "*.parquet"))[0]).metadata
    assert max(file.row_group(i).num_rows for i in range(file.num_row_groups)) <= 1024


def test_imputation_by_components(spark):
    """Equal cells of one place stay as they are; without values there is no cell."""
    cells = spark.createDataFrame([(i, 1, float(i % 4), float(i // 4)) for i in range(12)], "cell_id long, slice long, x double, y double")
    values = entries(spark, np.tile(np.array([[4.0, 0.0, 2.0, 1.0]]), (12, 1)) + np.eye(12, 4))
    out = {(r.cell_id, r.gene_id): r.value for r in J.impute_dataset(cells, values, k=1, n_pcs=2, min_genes=1, min_cells=1).collect()}
    want = {(r.cell_id, r.gene_id): r.value for r in values.collect()}
    assert out.keys() == want.keys() and all(np.isclose(out[x], want[x]) for x in want)


def test_single_nuclei_have_no_bins(spark):
    cells = spark.createDataFrame([(i, 1, "a" if i % 2 else "b", "train" if i else "valid") for i in range(6)], "cell_id long, slice long, cell_type string, split string").withColumns({"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")})
    genes = spark.createDataFrame([(i, f"ENSG{i}", i, i) for i in range(5)], "gene_id long, ensembl_id string, homo_connect_id long, gene_type_id long")
    values = entries(spark, np.random.default_rng(1).integers(1, 9, size=(6, 5)))
    out = J.tokenize_dataset(cells, values, genes, "human", "snrna", split="train", label="cell_type", chunk=2).collect()
    assert {r.cell_id for r in out} == {1, 2, 3, 4, 5} and sorted(r.chunk for r in out) == [0, 0, 1, 1, 2]
    assert all(r.density_token == 0 and set(r.X_deviation_bin) == {0} and r.cell_label == (r.cell_id % 2 == 0) and (r.specie_token, r.assay_token) == (3, 12) for r in out)
