"""The first rows of each group in a hashed order, without a task that orders a whole group.

A group's rows fall into buckets of their hash, counted in one pass. Whole buckets are in or out; only the one
bucket of a group in which its number ends is ranked, so few rows move and one group may hold all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialis.functions.scalars import hashed
from spatialis.sources.staging import staged

#: Rows that a bucket is meant to hold.
BUCKET = 4096


def _joined(rows: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """An inner join where null equals null; the other's columns come after those of the rows."""
    named = other.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in other.columns if c not in by])
    same = [rows[c].eqNullSafe(named[f"_by_{c}"]) for c in by]
    return rows.join(named, same).drop(*[f"_by_{c}" for c in by])


def group_sizes(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n): the groups and their numbers of rows."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def _placed(rows: DataFrame, by: list[str], sizes: DataFrame, salt: str, key: str) -> DataFrame:
    """`rows` with _hash, _bucket and `_end`: the bucket in which the group's number ends (`at`) and how many of
    its rows are in (`more`); null where all rows of the group are."""
    sizes = staged(sizes.select(*by, F.ceil(F.col("n") / BUCKET).alias("_buckets"), F.col("target").alias("_target")), "sizes")
    own = _joined(rows, sizes, by).withColumn("_hash", hashed(key, salt=salt)).withColumn("_bucket", F.floor(F.col("_hash") * F.col("_buckets")))
    counts = own.groupBy(*by, "_bucket", "_target").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket"))  # a row for every BUCKET rows of a group
    end = F.struct(F.col("_bucket").alias("at"), (F.col("_target") - F.col("_upto") + F.col("_n")).alias("more"))
    ends = counts.withColumn("_upto", upto).groupBy(*by).agg(F.min_by(F.when(F.col("_upto") > F.col("_target"), end), F.when(F.col("_upto") > F.col("_target"), F.col("_bucket"))).alias("_end"))
    return _joined(own, staged(ends, "ends"), by)


def first_of_groups(rows: DataFrame, by: list[str], sizes: DataFrame, salt: str, key: str = "cell_id") -> DataFrame:
    """`rows` with `_first`: whether a row is among the first `target` of its group by the hash of its key, then
    the key. `sizes` holds (by, n, target) of the groups; rows of groups that it lacks go. Null is a group."""
    placed = _placed(rows, by, sizes, salt, key)
    border = F.coalesce(F.col("_bucket") == F.col("_end.at"), F.lit(False))
    sure = placed.where(~border).withColumn("_first", F.coalesce(F.col("_bucket") < F.col("_end.at"), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_hash", key))
    ranked = placed.where(border).withColumn("_first", rank <= F.col("_end.more"))
    return sure.select(*rows.columns, "_first").unionByName(ranked.select(*rows.columns, "_first"))


def take_first(rows: DataFrame, by: list[str], target: Callable[[Column], Column] | DataFrame, salt: str, key: str = "cell_id") -> DataFrame:
    """The first rows of each group, their number by its size or by a table (by, n, target)."""
    sizes = target if isinstance(target, DataFrame) else group_sizes(rows, by).withColumn("target", target(F.col("n")))
    return first_of_groups(rows, by, sizes, salt, key).where("_first").drop("_first")
