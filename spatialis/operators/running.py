"""Sums along an order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatialis.sources.staging import staged


def running_sums(rows: DataFrame, by: list[str], order: str, *values: str) -> DataFrame:
    """`rows`, one for each (by, order), with before_<value>, the sum of a value over the group's rows that come
    before, total_<value>, that over all of them, and `following`, the next row's place in the order.

    Rows are dealt into ranges of (by, order), so a large group is spread over tasks; a table of one row for
    each group and range it lies in says what came before the range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(rows.repartitionByRange(n, *by, order).withColumn("_range", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy(*by, "_range").agg(F.min(order).alias("_first"), *[F.sum(v).alias(f"_{v}") for v in values])
    ranges, row = Window.partitionBy(*by).orderBy("_range"), Window.partitionBy(*by, "_range").orderBy(order)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = [F.sum(f"_{v}").over(Window.partitionBy(*by)).alias(f"total_{v}") for v in values]
    starts = parts.select(*by, "_range", F.lead("_first").over(ranges).alias("_next"), *[before(f"_{v}", ranges).alias(f"_{v}") for v in values], *totals)
    sums = [x for v in values for x in ((before(v, row) + F.col(f"_{v}")).alias(f"before_{v}"), F.col(f"total_{v}"))]
    return ranged.join(starts, [*by, "_range"]).select(*rows.columns, F.coalesce(F.lead(order).over(row), "_next").alias("following"), *sums)
