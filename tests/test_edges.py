"""Edge rules on small hand-made tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialis.operators import genes as G
from spatialis.operators import jobs as J
from spatialis.operators import metrics as E
from spatialis.operators import normalize as N
from spatialis.operators import perturb as X
from spatialis.operators import qc as Q
from spatialis.operators import sampling as M
from spatialis.operators import spatial as S
from spatialis.operators import tokens as T
from spatialis.operators import transfer as L


def expr(spark, rows):
    return spark.createDataFrame(rows, "cell_id long, gene_id long, value double")


def cells(spark, points, **more):
    df = spark.createDataFrame([(i, s, float(x), float(y)) for i, (s, x, y) in enumerate(points)], "cell_id long, slice long, x double, y double")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_a_cell_without_counts_is_divided_by_one(spark):
    assert N.normalize_total(expr(spark, [(1, 1, 0.0)])).first().value == 0.0


def test_equal_densities_have_bin_zero(spark):
    out = S.density_token(cells(spark, [(0, 0, 0), (0, 1000, 0), (0, 0, 1000)]), 10).collect()
    assert {r.density_token for r in out} == {0} and {r.density for r in out} == {1}


def test_a_group_of_one_cell(spark):
    edges = S.knn_in_group(cells(spark, [(0, 5, 5), (1, 0, 0), (1, 1, 1)]), 5, ["slice"])
    assert {(r.cell_id, r.nbr_id) for r in edges.collect()} == {(0, 0), (1, 1), (1, 2), (2, 1), (2, 2)}
    dev = S.deviation(edges, expr(spark, [(0, 9, 3.0), (1, 9, 4.0), (1, 8, 2.0)]))
    assert {(r.cell_id, r.gene_id): r.deviation for r in dev.collect()} == {(0, 9): 0.0, (1, 9): 2.0, (1, 8): 1.0, (2, 9): -2.0, (2, 8): -1.0}


@pytest.mark.parametrize("k", [1, 4, 9])
def test_knn_equals_brute_force(spark, k):
    rng = np.random.default_rng(k)
    points = [(i % 2, *(rng.integers(0, 30, 2) if i % 5 else rng.integers(500, 900, 2))) for i in range(150)]
    got = {}
    for r in S.knn_in_group(cells(spark, points), k, ["slice"]).collect():
        got.setdefault(r.cell_id, {})[r.rank] = r.nbr_id
    for i, (s, x, y) in enumerate(points):
        near = sorted((int((x - a) ** 2 + (y - b) ** 2), j) for j, (t, a, b) in enumerate(points) if t == s)[:k]
        assert [got[i][n] for n in range(1, len(near) + 1)] == [j for _, j in near]


def test_a_clump_and_a_crowded_place_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    points = [(0, 7, 7)] * 900 + [(0, *(100 + rng.random(2) * 1e-4)) for _ in range(900)] + [(0, *(rng.random(2) * 1e4)) for _ in range(100)] + [(1, 3, 3)] * 20
    found = S.knn_in_group(cells(spark, points), 6, ["slice"])
    got = {}
    for r in found.collect():
        got.setdefault(r.cell_id, {})[r.rank] = r.nbr_id
    place = np.array(points)
    for i, (s, x, y) in enumerate(points):
        d = np.where(place[:, 0] == s, (x - place[:, 1]) * (x - place[:, 1]) + (y - place[:, 2]) * (y - place[:, 2]), np.inf)
        assert [got[i][n] for n in range(1, 7)] == np.argsort(d, kind="stable")[:6].tolist()
    level = {r.cell_id: r.density for r in S.density_token(cells(spark, points), 1).collect()}
    assert {level[i] for i in range(1800)} == {900} and level[1900] == 20


def test_a_cell_without_a_place_takes_no_part(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 1.0), (2, 0, None, 1.0)], "cell_id long, slice long, x double, y double")
    assert [(r.cell_id, r.nbr_id) for r in S.knn_in_group(df, 3, ["slice"]).collect()] == [(1, 1)]


def test_a_value_at_an_edge_lies_in_the_lower_bin(spark):
    dev = spark.createDataFrame([(i, 1, float(i)) for i in range(6)], "cell_id long, gene_id long, deviation double")
    assert {r.cell_id: r.deviation_bin for r in S.deviation_bin(dev).collect()} == {0: 1, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5}


def test_homologs_keep_the_first_and_sum(spark):
    homology = spark.createDataFrame([("a", "T1", 1), ("a", "T2", 0), ("b", "T1", 2), ("c", None, 3), ("d", "T2", 4)], "source_gene string, target_gene string, ord long")
    assert {(r.source_gene, r.target_gene) for r in G.homolog_pairs(homology).collect()} == {("a", "T2"), ("b", "T1")}


def test_symbols(spark):
    genes = spark.createDataFrame([(1, "E1", "a"), (2, "E2", "b"), (3, "E3", "b")], "gene_id long, ensembl_id string, gene_symbol string")
    assert G.resolve_symbol(genes, "a").first().gene_id == 1
    for bad in ("b", "nosuch"):
        with pytest.raises(Exception, match="isn't that of one gene"):
            G.resolve_symbol(genes, bad).collect()
    with pytest.raises(Exception, match="Ensembl"):
        Q.check_ensembl(genes).collect()
    assert sorted(r.gene_symbol for r in G.unique_names(genes, "gene_symbol", ["gene_id"]).collect()) == ["a", "b", "b-1"]


def test_a_label_without_code_is_an_error(spark):
    df = spark.createDataFrame([("x",), ("y",)], "label string")
    with pytest.raises(Exception, match="no code"):
        G.label_encode(df, "label", G.label_codes(df.where("label = 'x'"), "label")).collect()


def test_small_slices_have_one_valid_cell(spark):
    out = M.split_by_slice(cells(spark, [(0, i, i) for i in range(4)]), "slice").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"valid": 1, "train": 3}


def test_cells_of_few_values_hold_nothing_out(spark):
    out = M.holdout_entries(expr(spark, [(1, g, 1.0) for g in range(5)] + [(2, g, 1.0) for g in range(20)]), 0.2, 0.1).collect()
    assert {r.part for r in out if r.cell_id == 1} == {"train"}
    assert [sum(r.part == p for r in out if r.cell_id == 2) for p in ("test", "valid", "train")] == [4, 2, 14]


def test_a_query_on_a_reference_takes_its_label(spark):
    ref = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 1, [1.1, 0.0])], "vec_id long, label int, embedding array<float>")
    asked = spark.createDataFrame([(9, 0, [0.0, 0.0])], ref.schema)
    assert L.knn_vote(L.top_neighbours(ref, asked, 3)).first().pred == 0
    assert L.knn_vote(L.top_neighbours(ref, asked, 3), weighted=False).first().pred == 1


def test_conditions_with_unknown_genes(spark):
    vec = spark.createDataFrame([(1, "Ab", [2.0, 4.0])], "gene_id long, gene_symbol string, embedding array<float>")
    cond = spark.createDataFrame([("Ab+zz",), ("ab",), ("ctrl",), ("Ab | ",)], "condition string")
    assert {r.condition: r.vector for r in X.condition_vectors(cond, vec, 2).collect()} == {"Ab+zz": [1.0, 2.0], "ab": [2.0, 4.0], "ctrl": [0.0, 0.0], "Ab | ": [2.0, 4.0]}


def test_overexpression(spark):
    data = expr(spark, [(1, 5, 2.0), (2, 5, 3.0), (3, 6, 1.0)])
    got = {(r.cell_id, r.gene_id): r.value for r in X.perturb_expr(data, [5], "overexpress").collect()}
    assert got == {(1, 5): 6.0, (2, 5): 6.0, (3, 5): 6.0, (3, 6): 1.0}
    with pytest.raises(ValueError):
        X.perturb_expr(data, [5], "overexpress", multiplier=None)


def test_tokens_are_cut_and_masks_keep_their_rules(spark):
    data = expr(spark, [(1, g, float(g + 1)) for g in range(50)])
    genes = spark.createDataFrame([(g, g % 7, g % 3) for g in range(50)], "gene_id long, homo_connect_id long, gene_type_id long")
    tokens = T.token_long(data, genes, spark.range(50).select(F.col("id").alias("gene_id"), F.lit(1.0).alias("mean")), max_length=30)
    row = T.token_rows(tokens).first()
    assert row.X == [g + 20 for g in range(49, 19, -1)] and len({len(v) for v in row[1:]}) == 1
    for r in T.mask_tokens(tokens, 100).collect():
        assert r.masked == r.token if r["mask"] == 1 else r.masked == 0 or r.masked == r.token or 20 < r.masked <= 120


def test_weights_sum_to_one(spark):
    pts = cells(spark, [(0, i % 5, i // 5) for i in range(25)])
    smooth = S.gaussian_smooth(S.knn_in_group(pts, 5, ["slice"]), expr(spark, [(i, 1, 1.0) for i in range(25)]))
    assert all(abs(r.value - 1) < 1e-9 for r in smooth.collect())


def test_perfect_predictions(spark):
    df = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "truth int, pred int")
    assert E.ari(df, "truth", "pred").first().ari == pytest.approx(1)
    assert E.nmi(df, "truth", "pred").first().nmi == pytest.approx(1)
    assert J.downstream_eval("annotation", df=df).first().accuracy == 1
    with pytest.raises(NotImplementedError):
        J.downstream_eval("perturbation", df=df)


def test_results_do_not_hang_on_partitions(spark):
    pts = cells(spark, [(i % 3, i * 7 % 31, i * 11 % 29) for i in range(90)])
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append((sorted(S.knn_in_group(pts, 4, ["slice"]).collect()), sorted(M.split_by_slice(pts, "slice").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
