"""Arrow helpers for vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, vec_id: str, embedding: str, zero: bool) -> DataFrame:
    """(vec_id, v array<double>) of rows whose vector has components, all finite, and an id; with
    `zero` false, vectors of zeros go too."""
    v = F.col("v")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    own = own.where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, fine))
    return own if zero else own.where(F.exists(v, lambda x: x != 0))


def matrix(column: pa.ChunkedArray | pa.Array, dtype: type = np.float64) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, -1) if n else np.empty((0, 0), dtype)


def blocks(id_column: str, n: Column | int, spread: bool = False) -> Column:
    """The block of a row by its id; with `spread`, rows of one id in other partitions lie elsewhere, so an
    id that very many rows share fills no block."""
    salt = [F.spark_partition_id()] if spread else []
    return F.pmod(F.xxhash64(F.lit(5), id_column, *salt), n if isinstance(n, Column) else F.lit(n)).cast("int")


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores, each id at its highest."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
