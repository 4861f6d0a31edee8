"""Sampling, splits and masks by hash: the same rows under any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialis.functions.scalars import hashed
from spatialis.operators.perturb import numbered
from spatialis.operators.selection import first_of_groups, group_sizes, take_first


def _rank(by: list[str], salt: str, key: str = "cell_id") -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(hashed(key, salt=salt), key))


def _size(by: list[str]) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*by))


def split_by_slice(cells: DataFrame, group: str, share: float = 0.1) -> DataFrame:
    """`split`: of each slice max(1, share of its cells) are `valid`, the rest `train`."""
    sizes = group_sizes(cells, [group]).withColumn("target", F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("n"))))
    return first_of_groups(cells.drop("split"), [group], sizes, "split").withColumn("split", F.when(F.col("_first"), "valid").otherwise("train")).drop("_first")


def split_random(cells: DataFrame, share: float = 0.1, seed: int = 42, exact: bool = False) -> DataFrame:
    """`split` by a threshold on the hash: about the share, without an order over all rows. With `exact`,
    ceil(share * n) cells of smallest hash are `valid`."""
    if exact:
        placed, size = numbered(cells, f"random-{seed}")
        valid = F.col("k") < F.ceil(F.round(F.col("m") * share, 9))
        return placed.crossJoin(size).withColumn("split", F.when(valid, "valid").otherwise("train")).drop("k", "m")
    return cells.withColumn("split", F.when(hashed("cell_id", salt=f"random-{seed}") < share, "valid").otherwise("train"))


def _oversample(column: str, factors: dict[str, float] | None) -> Column:
    if not factors:
        return F.lit(1.0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in factors.items() for x in (k, float(v))]), F.col(column)), F.lit(1.0))


def subsample_fix(cells: DataFrame, column: str, n: int, oversample: dict[str, float] | None = None) -> DataFrame:
    """min(n, size) * factor cells of each class, its size at most."""
    target = F.least("n", F.floor(F.least(F.lit(n), F.col("n")) * _oversample(column, oversample)))
    return take_first(cells, [column], group_sizes(cells, [column]).withColumn("target", target), "subsample")


def subsample_prop(cells: DataFrame, column: str, rate: float, alpha: float, oversample: dict[str, float] | None = None) -> DataFrame:
    """Classes by weight (share ^ alpha, normalised) of rate * all cells, their size at most."""
    size = group_sizes(cells, [column])
    total = size.agg(F.sum("n").alias("total"))
    weighted = size.crossJoin(F.broadcast(total)).withColumn("w", F.pow(F.col("n") / F.col("total"), F.lit(alpha)))
    every = weighted.agg(F.sum("w").alias("every"))
    target = F.floor(F.round(F.col("w") / F.col("every") * F.col("total") * rate, 6) * _oversample(column, oversample))
    return take_first(cells, [column], weighted.crossJoin(F.broadcast(every)).select(column, "n", F.least("n", target).alias("target")), "subsample")


def subsample_marker(cells: DataFrame, column: str, score: str, n: int, pool_factor: int = 3) -> DataFrame:
    """n cells of each class, drawn from the n * pool_factor of highest marker score."""
    best = F.row_number().over(Window.partitionBy(column).orderBy(F.desc(score), "cell_id"))
    pool = cells.withColumn("_p", best).where(F.col("_p") <= n * pool_factor).drop("_p")
    return pool.withColumn("_r", _rank([column], "subsample")).where(F.col("_r") <= n).drop("_r")


def pick_slice_capped(cells: DataFrame, group: str, cap: int) -> DataFrame:
    """One slice, that of the smallest hash, and at most cap of its cells."""
    one = cells.select(group).distinct().orderBy(hashed(group, salt="slice"), group).limit(1)
    return cells.join(F.broadcast(one), group, "left_semi").orderBy(hashed("cell_id", salt="cap"), "cell_id").limit(cap)


def sample_ratio(cells: DataFrame, group: str, ratio: float) -> DataFrame:
    """floor(size * ratio) cells of each group; none where that is 0."""
    return take_first(cells, [group], lambda n: F.floor(n * ratio), "cells")


def sample_cells(cells: DataFrame, group: str, n: int) -> DataFrame:
    """At most n cells of each group."""
    return take_first(cells, [group], lambda size: F.least(size, F.lit(n)), "cells")


def sample_genes_by_sparsity(zero_rates: DataFrame, edges: tuple[float, ...] = (0.75, 0.9, 0.95), n: int = 25) -> DataFrame:
    """At most n genes of each bin of zero rate, closed to the right; a rate of 0 falls into none."""
    at = F.when(F.col("zero_rate") > 0, sum((F.when(F.col("zero_rate") > e, 1).otherwise(0) for e in edges), F.lit(0)))
    binned = zero_rates.withColumn("bin", at.cast("int")).where("bin is not null")
    return binned.withColumn("_r", _rank(["bin"], "genes", "gene_id")).where(F.col("_r") <= n).drop("_r")


def holdout_entries(expr: DataFrame, test: float, valid: float, scale: float | None = None, least: int = 5) -> DataFrame:
    """`part` of each value: floor(test * nnz), then floor(valid * nnz) of a cell's values are held out;
    cells of `least` values or fewer keep all. With `scale`, values are drawn without replacement by the
    weight exp(-value / scale)."""
    u = hashed("cell_id", "gene_id", salt="holdout")
    order = u if scale is None else -F.log(F.greatest(u, F.lit(1e-12))) / F.exp(-F.col("value") / scale)
    r = F.row_number().over(Window.partitionBy("cell_id").orderBy(order, "gene_id"))
    nnz = _size(["cell_id"])
    part = F.when(nnz <= least, "train").when(r <= F.floor(nnz * test), "test").when(r <= F.floor(nnz * test) + F.floor(nnz * valid), "valid").otherwise("train")
    return expr.withColumn("part", part)


def mask_entries(expr: DataFrame, cell_share: float, entry_share: float, renormalize: bool = False) -> DataFrame:
    """A share of the cells has a share of its values set to zero. With `renormalize`, values are logarithms, and
    those that stay in such a cell grow by -log(1 - entry_share)."""
    cell, entry = hashed("cell_id", salt="mask-cell") < cell_share, hashed("cell_id", "gene_id", salt="mask-entry") < entry_share
    kept = F.col("value") + F.when(cell, -math.log(1 - entry_share)).otherwise(0.0) if renormalize else F.col("value")
    return expr.withColumn("value", F.when(cell & entry, 0.0).otherwise(kept))


def drop_nodes(cells: DataFrame, rate: float, most: int) -> DataFrame:
    """min(most, floor(n * (1 - rate))) cells: a limit, so no more than `most` rows meet."""
    n = cells.count()
    return cells.orderBy(hashed("cell_id", salt="nodes"), "cell_id").limit(min(most, int(n * (1 - rate) + 1e-9)))


def keep_aligned(kept: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Each table's rows of the cells that were kept."""
    return [t.join(kept.select("cell_id"), "cell_id", "left_semi") for t in tables]


def shuffle_rows(cells: DataFrame, group: list[str]) -> DataFrame:
    """Rows of a group in hashed order."""
    return cells.repartition(*group).sortWithinPartitions(*group, hashed("cell_id", salt="shuffle"))
