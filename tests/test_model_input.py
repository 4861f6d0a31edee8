"""Model input in batches: files, row groups, manifest."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spatialis.operators import perturb as X
from spatialis.operators import tokens as T
from spatialis.sources import tables


def rows(spark, n, gap=7):
    """Token rows of n cells whose ids have gaps."""
    return spark.range(n).select(
        (F.col("id") * gap).alias("cell_id"),
        F.array(F.lit(0).cast("long"), F.col("id") + 30, F.lit(50).cast("long")).alias("X"),
        *[F.array(*[F.lit(i) for i in range(3)]).alias(c) for c in ("X_connect_comp", "X_rna_type", "X_deviation_bin")],
        F.array(*[F.lit(float(i)) for i in range(3)]).alias("X_exp"),
        F.lit(5).alias("cell_label"),
        F.lit(4).alias("specie_token"),
        F.lit(17).alias("density_token"),
    )


def test_batches_are_full_and_lie_in_row_groups_of_their_own(spark, tmp_path):
    path = str(tmp_path / "input")
    made = T.model_rows(rows(spark, 1000), 3000, 64, context=2)
    manifest = tables.write_model_input(made, path, 64).collect()
    assert sorted((r.batch_id, r.n) for r in manifest) == [(i, 64) for i in range(15)] + [(15, 40)]
    assert len({r.file for r in manifest}) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    for r in manifest:
        group = pq.ParquetFile(f"{path}/{r.file}").read_row_group(r.row_group)
        assert set(group["batch_id"].to_pylist()) == {r.batch_id} and group.num_rows == r.n and r.first_row == 64 * r.row_group
    one = tables.read_batch(spark, path, 3)
    assert len(one.inputFiles()) == 1 and sorted(r.cell_id for r in one.collect()) == [7 * i for i in range(192, 256)]
    with pytest.raises(ValueError, match="no batch"):
        tables.read_batch(spark, path, 99)


def test_a_row_of_model_input(spark):
    r = T.model_rows(rows(spark, 3), 3000, 64, context=2, p=0.0).where("cell_id = 7").first()
    # Species and density before two tokens; no assay is there; token 0 becomes the padding 1.
    assert r.real_indices == r.masked_indices == [4, 17, 1, 31] and r.mask == [1] * 4 and r.attention_mask == [False, False, True, False]
    assert r.exp == [0.0, 0.0, 0.0, 1.0] and r.connect_comp == r.rna_type == r.neighbor_gene_distribution == [0, 0, 0, 1]
    assert (r.cell_raw_index, r.cell_label, r.batch_id) == ("7", 5, 0)
    bare = T.model_rows(rows(spark, 3), 3000, 64, prefix=False, p=1.0).where("cell_id = 7").first()
    assert len(bare.mask) == 3 and bare.mask == [1, 0, 0]
    assert T.model_rows(rows(spark, 0), 3000, 64).count() == 0


def test_masks_of_rows_and_of_tokens_agree(spark):
    own = rows(spark, 400)
    long = own.select("cell_id", F.posexplode("X").alias("pos", "token"))
    want = {(r.cell_id, r.pos): r.masked for r in T.mask_tokens(long, 3000).collect()}
    got = {(r.cell_id, i): m for r in T.model_rows(own, 3000, 64, prefix=False).collect() for i, m in enumerate(r.masked_indices)}
    assert got == want and 0.04 < np.mean([m == 0 for m in got.values()]) < 0.12


def test_errors_of_sinks_and_targets(spark, tmp_path):
    with pytest.raises(ValueError, match="embedding"):
        tables.write_vec(spark.range(1).withColumnRenamed("id", "vec_id"), str(tmp_path / "v"))
    with pytest.raises(ValueError, match="vec_id"):
        tables.write_vec(spark.range(1).select(F.array("id").alias("embedding")), str(tmp_path / "v"))
    expr = spark.createDataFrame([(1, 2, 3.0)], "cell_id long, gene_id long, value double")
    for mode in ("knockout", "overexpress"):
        with pytest.raises(ValueError, match="no target cells"):
            X.perturb_expr(expr, [2], mode, expr.where("false"))
