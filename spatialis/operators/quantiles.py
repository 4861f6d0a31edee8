"""Exact quantiles of groups by radix selection: bins are counted, and only those that hold a wanted rank are
looked into, so no order over all rows is made and one group may hold all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialis.sources.staging import staged

#: Bins into which a bin is parted, and rows up to which a bin is sorted instead.
BINS, SMALL = 256, 4096


def _value(r: Column) -> Column:
    """The value at rank r of a bin, if it can be told without looking inside."""
    return F.when((r == F.col("start")) | (F.col("lo") == F.col("hi")), F.col("lo")).when(r == F.col("start") + F.col("n") - 1, F.col("hi"))


def _within(values: DataFrame, bins: DataFrame, by: str, *columns: str) -> DataFrame:
    """The rows that lie in a bin, with some of the bin's columns; bins of a group don't overlap."""
    edges = bins.select(F.col(by).alias("_by"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), *columns)
    return values.join(edges, (values[by] == edges["_by"]) & (F.col("v") >= F.col("_lo")) & (F.col("v") <= F.col("_hi"))).select(by, "v", "w", *columns)


def _parted(values: DataFrame, bins: DataFrame, by: str) -> DataFrame:
    """The parts of bins that hold a wanted rank: by, start (rows of the group before them), n, lo, hi, ranks."""
    at = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))
    counted = _within(values, bins, by, "start", "lo", "hi").groupBy(by, "start", at.alias("at")).agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = F.sum("n").over(Window.partitionBy(by, "start").orderBy("at"))  # at most BINS rows of a bin
    placed = counted.join(bins.select(by, "start", "ranks"), [by, "start"]).withColumn("start", F.col("start") + upto - F.col("n"))
    ranks = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))
    return placed.select(by, "start", "n", "lo", "hi", ranks.alias("ranks")).where(F.size("ranks") > 0)


def order_statistics(values: DataFrame, by: str, column: str, ranks: list[Column], weight: str | None = None) -> DataFrame:
    """(by, n, found): each group's number of values and, at each rank (from 0, columns over n), its value, as a
    map. Nulls, NaN and rows without a group take no part. `values` is read several times: best a written table. A row
    stands for as many values as the column `weight` says, where one is named, else for one.

    A group's values between its least and greatest fall into BINS bins of equal width, counted in one pass
    with a row for each bin and task at most. A bin with a wanted rank is parted again if it holds more than
    SMALL rows, else its rows are sorted."""
    own = values.select(by, F.col(column).cast("double").alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")).where(F.col(by).isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    stats = own.groupBy(by).agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    bins = staged(stats.select(by, F.lit(0).cast("long").alias("start"), "n", "lo", "hi", F.array_distinct(F.array(*[r.cast("long") for r in ranks])).alias("ranks")), "bins")
    size = bins.select(by, "n")
    known, small = [], []
    while True:
        told = F.filter(F.transform("ranks", lambda r: F.struct(r.alias("rank"), _value(r).alias("value"))), lambda x: x["value"].isNotNull())
        known.append(bins.select(by, F.explode(told).alias("x")).select(by, "x.*"))
        bins = bins.withColumn("ranks", F.filter("ranks", lambda r: _value(r).isNull())).where(F.size("ranks") > 0)
        small.append(bins.where(F.col("n") <= SMALL))
        bins = bins.where(F.col("n") > SMALL)
        if bins.isEmpty():
            break
        bins = staged(_parted(own, bins, by), "bins")
    left = reduce(DataFrame.unionByName, small)
    if not left.isEmpty():
        upto = F.col("start") + F.sum("w").over(Window.partitionBy(by, "start").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        wanted = staged(left.select(by, "start", F.explode("ranks").alias("rank")), "ranks")
        placed = _within(own, left, by, "start").select(by, "start", F.col("v").alias("value"), "w", upto.alias("upto"))
        known.append(placed.join(wanted, [by, "start"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("w"))).select(by, "rank", "value"))
    found = reduce(DataFrame.unionByName, known).groupBy(by).agg(F.map_from_entries(F.collect_set(F.struct("rank", "value"))).alias("found"))
    return size.join(found, by)


def quantiles(values: DataFrame, by: str, column: str, shares: tuple[float, ...], weight: str | None = None) -> DataFrame:
    """(by, q): the quantiles of each group, linearly interpolated; a row counts `weight` times."""
    at = [F.lit(q) * (F.col("n") - 1) for q in shares]
    at_rank = lambda r: F.element_at("found", r.cast("long"))
    between = lambda x: at_rank(F.floor(x)) + (at_rank(F.ceil(x)) - at_rank(F.floor(x))) * (x - F.floor(x))
    own = order_statistics(values, by, column, [end(x) for x in at for end in (F.floor, F.ceil)], weight)
    return own.select(by, F.array(*map(between, at)).alias("q"))


def quantile_edges(values: DataFrame, by: str, column: str, shares: tuple[float, ...], weight: str | None = None) -> DataFrame:
    """The quantiles rounded to 6 decimals, for edges that shouldn't hang on the last digits."""
    return quantiles(values, by, column, shares, weight).withColumn("q", F.transform("q", lambda q: F.round(q, 6)))


def with_quantile_edges(rows: DataFrame, by: str, column: str, shares: tuple[float, ...], weight: str | None = None) -> DataFrame:
    """`rows` with `q`, their group's quantile_edges, in one shuffle: for groups that a task can order. Nulls and NaN
    take no part; groups of nothing else go. A row counts `weight` times."""
    v, times = F.col(column).cast("double"), F.col(weight) if weight else F.lit(1)
    there = v.isNotNull() & ~F.isnan(v)
    group = Window.partitionBy(by)
    upto = F.sum(times).over(group.orderBy(F.when(there, 0).otherwise(1), column).rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumns({"_there": there, "_at": upto - times, "_times": times, "_n": F.coalesce(F.sum(F.when(there, times)).over(group), F.lit(0))})
    at_rank = lambda r: F.max(F.when(F.col("_there") & (F.col("_at") <= r) & (F.col("_at") + F.col("_times") > r), v)).over(group)
    between = lambda x: (F.floor(x), F.ceil(x), x - F.floor(x))
    ranks = [between(F.lit(q) * (F.col("_n") - 1)) for q in shares]
    ends = placed.withColumns({f"_{side}{i}": at_rank(r[j]) for i, r in enumerate(ranks) for j, side in enumerate(("lo", "hi"))})
    edge = lambda i: F.round(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * ranks[i][2], 6)
    return ends.where("_n > 0").select(*rows.columns, F.array(*map(edge, range(len(shares)))).alias("q"))
