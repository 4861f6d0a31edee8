"""Cases that a review of larger tables found."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialis.operators import inverted as I
from spatialis.operators import jobs as J
from spatialis.operators import metrics as E
from spatialis.operators import spatial as S
from spatialis.operators import tokens as T
from spatialis.operators import transfer as L
from spatialis.operators import vectors as V
from spatialis.operators.running import running_sums
from spatialis.plans import registry
from tests.conftest import SF


def test_no_symbol_is_that_of_one_gene(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet")
    part.unionByName(part.withColumn("p_partkey", part.p_partkey + 11_000)).write.parquet(f"{tmp_path}/part.parquet")
    assert registry.queries()["X2_resolve_symbol"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_exact_neighbours_in_blocks(spark, monkeypatch, metric):
    """Ties, equal vectors, vectors with NaN and rows without one, over several blocks of both sides."""
    for name, n in (("REF_BLOCK", 300), ("QUERY_BLOCK", 20), ("CELLS", 2000)):
        monkeypatch.setattr(L, name, n)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(1, 4, (900, 3)), rng.normal(size=(300, 3)) + 50]).astype(float)
    x[7], x[8, 1] = 1e6, np.nan
    ref = [(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(5000, 1, None)]
    asked = [(i, v.tolist()) for i, v in enumerate(x[::20])] + [(900, None)]
    got = L.top_neighbours(spark.createDataFrame(ref, "vec_id long, label int, embedding array<double>"), spark.createDataFrame(asked, "vec_id long, embedding array<double>"), 7, metric).collect()
    for i, v in asked[:-1]:
        d = np.sqrt(((x - v) ** 2).sum(axis=1)) if metric == "euclidean" else 1 - x @ np.array(v) / np.sqrt((x * x).sum(axis=1) * np.dot(v, v))
        d = np.round(np.nan_to_num(d, nan=np.inf), 9)
        order = np.lexsort((np.arange(len(x)), d))[:7]
        own = sorted((r.rank, r.vec_id, r.label, r.dist) for r in got if r.query_id == i)
        assert [r[1] for r in own] == order.tolist() and [r[2] for r in own] == [j % 3 for j in order.tolist()]
        assert np.allclose([r[3] for r in own], d[order], atol=1e-9)
    assert {r.query_id for r in got} == {i for i, _ in asked[:-1]}


def test_kernel_means_meet_each_pair_of_blocks_once(spark, monkeypatch):
    monkeypatch.setattr(E, "KERNEL_BLOCK", 50)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    x[100:140] = x[:40]  # equal vectors
    rows = spark.createDataFrame([(i, 1 + i % 2, "young" if i % 3 else "old", v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, slice string, embedding array<double>")
    k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(axis=2)).mean()
    mmd = lambda a, b: k(a, a) + k(b, b) - 2 * k(a, b)
    at = np.arange(400)
    young, old = x[at % 3 > 0], x[at % 3 == 0]
    assert E.mmd_rbf(rows.where("slice = 'young'"), rows.where("slice = 'old'")).first().mmd == pytest.approx(mmd(young, old), abs=1e-12)
    # Blocks of a pair are copied once, not for either order.
    vectors = E.distinct_vectors(rows, "vectors")
    n = -(-vectors.count() // 50)
    assert n * (n + 1) // 2 == E.block_pairs(vectors, None)[0].select("i", "j").distinct().count()
    shift = J.shift_to_young(rows, rows, "young", "old", 1).first()
    assert shift.mmd_before == pytest.approx(mmd(x[(at % 3 > 0) & (at % 2 == 0)], x[(at % 3 == 0) & (at % 2 == 0)]), abs=1e-12)


def test_values_of_neighbours_meet_by_parts(spark, monkeypatch):
    """Parts of few cells, crowded places, pieces of few entries, cells without values or places; a cell's values go to
    few parts and not to each of its neighbours."""
    monkeypatch.setattr(S, "PART", 16)
    monkeypatch.setattr(S, "ENTRIES", 100)
    rng = np.random.default_rng(4)
    xy = rng.integers(0, 25, (500, 2)).astype(float)
    xy[:60] = 3.0
    cells = spark.createDataFrame([(i, int(i % 2), *map(float, v)) for i, v in enumerate(xy)], "cell_id long, slice long, x double, y double")
    m = rng.integers(1, 9, (505, 12)) * (rng.random((505, 12)) < 0.4)
    m[10:14] = 0
    expr = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m) if v], "cell_id long, gene_id long, value double")
    edges = S.knn_in_group(cells, 8, ["slice"], leaf=64, part=True).cache()
    by = {}
    for r in edges.collect():
        by.setdefault(r.cell_id, []).append(r.nbr_id)
    want = {(c, j): m[c, j] - m[n, j].mean() for c, n in by.items() for j in range(12) if m[c, j] or m[n, j].any()} | {(c, j): m[c, j] for c in range(500, 505) for j in range(12) if m[c, j]}
    got = {(r.cell_id, r.gene_id): r.deviation for r in S.deviation(edges, expr).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    bare = {(r.cell_id, r.gene_id): r.deviation for r in S.deviation(edges.drop("_part"), expr).collect()}
    assert bare == pytest.approx(got)
    assert edges.select("_part", "nbr_id").distinct().count() < 0.6 * edges.count()
    assert max(r["count"] for r in edges.select("_part", "cell_id").distinct().groupBy("_part").count().collect()) <= 64


def test_bins_of_small_and_large_genes(spark):
    """Either way gives the same bins, those of NumPy's quantiles."""
    rng = np.random.default_rng(6)
    rows = [(i, int(g), round(float(v), 2)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 3000), rng.normal(size=3000)))] + [(9000, 1, float("nan")), (9001, 5, None)]
    dev = spark.createDataFrame(rows, "cell_id long, gene_id long, deviation double")
    ways = [{(r.cell_id, r.gene_id): r.deviation_bin for r in S.deviation_bin(dev, large).collect() if r.cell_id < 9000} for large in (10, 1 << 20)]
    edges = {g: np.round(np.quantile([v for _, h, v in rows[:3000] if h == g], [0.2, 0.4, 0.6, 0.8]), 6) for g in range(3)}
    assert ways[0] == ways[1] == {(i, g): int((edges[g] < v).sum()) + 1 for i, g, v in rows[:3000]}


def test_vectors_of_genes_meet_tokens_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "CELLS", 8)
    monkeypatch.setattr(V, "PIECE", 10)
    rng = np.random.default_rng(9)
    e = rng.normal(size=(6, 4))
    tokens = [(c, g, float(w)) for c in range(40) for g, w in enumerate(rng.integers(0, 4, 8))] + [(99, 7, 1.0)]  # genes 6 and 7 have no vector
    genes = spark.createDataFrame([(g, v.tolist()) for g, v in enumerate(e)] + [(6, None)], "gene_id long, embedding array<float>")
    rows = spark.createDataFrame(tokens, "cell_id long, gene_id long, weight double")
    got = {r.cell_id: r.embedding for r in V.pool_weighted(rows, genes).collect()}
    w = np.array([x for _, _, x in tokens[:-1]]).reshape(40, 8)[:, :6]
    want = w @ e / w.sum(axis=1)[:, None]
    assert got.keys() == set(range(40)) and all(np.allclose(got[c], want[c], atol=1e-6) for c in got)
    summed = {r.cell_id: r.embedding for r in V.gene_vector_embed(rows.withColumnRenamed("weight", "value"), genes).collect()}
    assert all(np.allclose(summed[c], np.log1p(w[c]) @ e, atol=1e-6) for c in range(40))


@pytest.mark.parametrize("hashes", ["xxhash64", "size"])
def test_equal_vectors_of_genes_move_once_to_a_block(spark, monkeypatch, hashes):
    """B1, B2, B5: a block has as many genes as tokens, whose vectors are few; hashes of vectors may be equal."""
    monkeypatch.setattr(V, "CELLS", 8)
    if hashes == "size":
        monkeypatch.setattr(V.F, "xxhash64", lambda c: V.F.size(c).cast("long"))
    sent = []
    real = type(spark.range(1).groupBy("id")).cogroup
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "cogroup", lambda self, other: sent.append(other._df) or real(self, other))
    rng = np.random.default_rng(13)
    e = rng.normal(size=(5, 4)).astype(np.float32)
    e[4] = np.nan
    tokens = [(c, c * 6 + g, float(g % 4)) for c in range(40) for g in range(6)] + [(99, 10_000, 1.0)]  # the last gene has no vector
    genes = spark.createDataFrame([(g, e[g % 4 if g else 4].tolist()) for g in range(240)] + [(10_000, None)], "gene_id long, embedding array<float>")
    rows = spark.createDataFrame(tokens, "cell_id long, gene_id long, weight double")
    got = {r.cell_id: r.embedding for r in V.pool_weighted(rows, genes).collect()}
    w = np.arange(6) % 4
    want = {c: w @ e[[(c * 6 + g) % 4 if c + g else 4 for g in range(6)]].astype(float) / w.sum() for c in range(40)}
    assert got.keys() == want.keys() and all(np.allclose(got[c], want[c], atol=1e-6, equal_nan=True) for c in got)
    # Five blocks of 48 genes each: of four vectors, and the first of one more.
    assert sent[0].where("size(embedding) > 0").count() == 21


def test_lists_are_searched_in_groups(spark, monkeypatch):
    """A query leaves k rows in a group of lists, and all lists of few rows are visited: the neighbours are exact."""
    monkeypatch.setattr(I, "ROWS", 64)
    monkeypatch.setattr(I, "STEP", 7)
    monkeypatch.setattr(I, "HELD", 1.0)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 5))
    schema = "vec_id long, label int, embedding array<double>"
    ref = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], schema)
    asked = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x[:90])], schema)
    got = I.approximate_neighbours(ref, asked, 6).collect()
    for i in range(90):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        near = [r.vec_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)]
        assert len(near) == 6 and len(set(near) & set(np.argsort(d)[:6].tolist())) >= 5 and near[0] == i


def test_cells_of_model_rows_are_numbered_by_their_ids_alone(spark, monkeypatch):
    """What is ordered over all cells has no arrays."""
    seen = []
    monkeypatch.setattr(T, "running_sums", lambda rows, *rest: seen.append(rows.columns) or running_sums(rows, *rest))
    rows = spark.range(10).select((F.col("id") * 3).alias("cell_id"), *[F.array(F.lit(30)).alias(c) for c in ("X", "X_connect_comp", "X_rna_type", "X_deviation_bin", "X_exp")], F.lit(0).alias("cell_label"))
    assert {r.cell_id: r.batch_id for r in T.model_rows(rows, 3000, 4).collect()} == {3 * i: i // 4 for i in range(10)}
    assert seen == [["cell_id", "_all", "_one"]]


def test_averages_of_all_genes_are_not_written(spark, monkeypatch):
    """L9: genes that go in quality control, cells without values, values of zero and NaN, two genes of a target; nothing that
    is written has a row for each average."""
    rows = {}
    for module in (S, J):
        monkeypatch.setattr(module, "staged", lambda df, name, real=module.staged: rows.setdefault(name, []).append(out := real(df, name)) or out)
    rng = np.random.default_rng(5)
    xy = rng.random((300, 2)) * 50
    cells = spark.createDataFrame([(i, i % 2, *map(float, v)) for i, v in enumerate(xy)], "cell_id long, slice long, x double, y double")
    m = rng.integers(1, 9, (300, 400)) * (rng.random((300, 400)) < 0.03)
    m[:, 390:] = 0
    m[40:50] = 0
    m = m.astype(float)
    m[7, 15] = np.nan  # a gene without a target: NaN counts as above zero
    held = (m != 0) | (rng.random(m.shape) < 0.005)
    held[:, 396:] = False
    expr = spark.createDataFrame([(i, j, float(m[i, j])) for i, j in np.argwhere(held).tolist()], "cell_id long, gene_id long, value double")
    genes = spark.createDataFrame([(j, f"S{j % 20}") for j in range(400)], "gene_id long, gene_symbol string")
    homology = spark.createDataFrame([(f"S{j}", f"T{j}", j) for j in range(15)], "source_gene string, target_gene string, ord long")
    got = {(r.cell_id, r.gene_id): r.value for r in J.prepare_dataset(cells, expr, genes, homology, 1000, 19).collect()}
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    d2[np.arange(300)[:, None] % 2 != np.arange(300) % 2] = np.inf
    near = np.argsort(d2, axis=1, kind="stable")[:, :20]
    own = np.take_along_axis(d2, near, axis=1)
    w = np.exp(-own / (2 * round(float(np.median(np.sqrt(own[:, 1:]))), 6) ** 2))
    w /= w.sum(axis=1)[:, None]
    smooth, there = np.einsum("ck,ckg->cg", w, m[near]), held[near].any(axis=1)
    smooth[~there] = 0
    above = there & ((smooth > 0) | np.isnan(smooth))
    good = above.sum(axis=1) >= 4
    kept = above[good].sum(axis=0) >= 3
    want = {}
    for c, g in np.argwhere(there & good[:, None] & kept).tolist():
        if g % 20 < 15:
            want[c, f"T{g % 20}"] = want.get((c, f"T{g % 20}"), 0) + smooth[c, g]
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=1e-9, equal_nan=True) for k in got)
    assert max(df.count() for name, of in rows.items() if name != "apart" for df in of) < 0.5 * there.sum()


def test_tables_that_grow_are_not_broadcast(spark, tmp_path):
    """K2: tables of cells and genes, and neighbours, small as their files may be."""
    spark.range(500).selectExpr("id as cell_id", "id % 2 as slice", "double(id % 83) as x", "double(id % 5) as y").write.parquet(f"{tmp_path}/cells")
    spark.range(500).selectExpr("id as gene_id", "id as homo_connect_id", "double(id) as mean").write.parquet(f"{tmp_path}/genes")
    cells, genes = spark.read.parquet(f"{tmp_path}/cells"), spark.read.parquet(f"{tmp_path}/genes")
    known = T.align_genes(spark.range(0).selectExpr("id as cell_id", "id as gene_id", "double(id) as value"), genes.drop("mean"), genes.select("gene_id", "mean"))
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    own = [line for line in plan(known).splitlines() if "Join" in line]
    assert "SortMergeJoin" in own[-1]
    for df in (S.knn_in_group(cells, 3, ["slice"]), S.knn_in_group(cells, 3, ["slice"], part=True)):
        assert "BroadcastHashJoin" not in plan(df) and df.count() == 1500
    level = S.density_token(cells, 3.0)
    # The edges of slices may be: one row for each.
    assert plan(level).count("BroadcastHashJoin") <= 1 and level.count() == 500


@pytest.mark.parametrize("hot", [7, 2048])
@pytest.mark.parametrize("crowd", [1, 10**9])
def test_pairs_within_a_radius_keep_all_tasks(spark, monkeypatch, hot, crowd):
    """J10: few bytes of cells make many pairs, so tasks are not merged by bytes; squares of either width, parted or not, places
    at squares' edges, crowded or too far for a square's number to be exact, and cells without a place."""
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "CROWD", crowd, raising=False)
    rng = np.random.default_rng(10)
    xy = np.concatenate([rng.integers(-8, 9, (300, 2)) * 2.5, rng.normal(size=(200, 2)) * 30, np.full((20, 2), 0.1), [[1e30, 1], [1e30, 2], [-1e30, 1e9], [1e300, -1e300], [1e12, 5], [1e12 + 5, 5], [1e12 + 10.5, 5]]])
    points = [(i, i % 2 if i < 520 else 0, *map(float, v)) for i, v in enumerate(xy)]
    cells = spark.createDataFrame([*points, (9000, 0, float("nan"), 0.0), (9001, 0, None, 1.0), (9002, None, 1.0, 1.0)], "cell_id long, slice long, x double, y double")
    pairs = S.radius_pairs(cells, 5.0, ["slice"])
    of = np.array([p[1] for p in points])
    with np.errstate(over="ignore"):
        d2 = (xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2
    want = {(int(of[a]), int(a), int(b), float(d2[a, b])) for a, b in np.argwhere((d2 <= 25) & (of[:, None] == of))}
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want
    assert pairs.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert S.radius_pairs(cells.where("false"), 5.0, ["slice"]).count() == 0


@pytest.mark.parametrize("large", [30, 1 << 20])
@pytest.mark.parametrize(("absolute", "low"), [(False, None), (True, 1.0)])
def test_bins_of_held_values_are_those_of_all_deviations(spark, monkeypatch, large, absolute, low):
    """K2: crowded places, cells without places, equal and NaN values, stored zeros, genes of few and of many values."""
    monkeypatch.setattr(S, "PART", 16)
    rng = np.random.default_rng(11)
    xy = rng.integers(0, 25, (300, 2)).astype(float)
    xy[:40] = 3.0
    cells = spark.createDataFrame([(i, int(i % 2), *map(float, v)) for i, v in enumerate(xy)], "cell_id long, slice long, x double, y double")
    m = rng.integers(0, 9, (305, 12)).astype(float)
    m[5, 3] = np.nan
    held = rng.random((305, 12)) < np.linspace(0.01, 0.5, 12)
    expr = spark.createDataFrame([(i, j, float(m[i, j])) for i, j in np.argwhere(held).tolist()], "cell_id long, gene_id long, value double")
    edges = S.knn_in_group(cells, 8, ["slice"], leaf=64, part=True).cache()
    dev = S.deviation(edges, expr, absolute, low)
    want = {(r.cell_id, r.gene_id): r.deviation_bin for r in S.deviation_bin(dev).collect() if held[r.cell_id, r.gene_id]}
    rows = S.held_bins(edges, expr, absolute, low, large).collect()
    assert {(r.cell_id, r.gene_id): r.deviation_bin for r in rows} == want and len(rows) == len(want)


def test_deviations_of_all_neighbours_are_not_written(spark, monkeypatch):
    """K2: nothing that is written, or ordered by gene, has a row for each deviation."""
    rows, ordered = [], []
    for module in (S, J):
        monkeypatch.setattr(module, "staged", lambda df, name, real=module.staged: rows.append(out := real(df, name)) or out)
        if hasattr(module, "with_quantile_edges"):
            monkeypatch.setattr(module, "with_quantile_edges", lambda df, *rest, real=module.with_quantile_edges: ordered.append(df) or real(df, *rest))
    rng = np.random.default_rng(12)
    cells = spark.createDataFrame([(i, 0, "R", "t", *map(float, v)) for i, v in enumerate(rng.random((400, 2)) * 50)], "cell_id long, slice long, region string, cell_type string, x double, y double")
    expr = spark.createDataFrame([(c, int(g), float(rng.integers(1, 9))) for c in range(400) for g in rng.choice(300, 6, replace=False)], "cell_id long, gene_id long, value double")
    genes = spark.range(300).selectExpr("id as gene_id", "concat('ENSG', id) as ensembl_id", "id as homo_connect_id", "id as gene_type_id")
    out = J.tokenize_dataset(cells, expr, genes, label="cell_type", k=30)
    assert out.count() == 400
    number = S.deviation(S.knn_in_group(cells, 30, ["slice"]), expr).count()
    assert len(ordered) == 1 and max(df.count() for df in [*rows, *ordered]) < 0.4 * number


def test_the_scale_of_places_is_made_once(spark):
    """K2: places are read twice and joined by their coordinates, so the mean that scales them is no sum made anew."""
    cells = spark.range(60).selectExpr("id as cell_id", "0L as slice", "double(id * 7 % 11) as x", "double(id % 13) as y", "'MERFISH' as platform")
    um = S.to_microns(cells, ["slice"])
    assert "FlatMapGroupsInArrow" not in um._jdf.queryExecution().sparkPlan().toString() and um.count() == 60
