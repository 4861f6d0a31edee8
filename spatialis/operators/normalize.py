"""Library-size normalisation and gene statistics; absent values are zeros and count as such."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialis.operators.quantiles import order_statistics
from spatialis.sources.staging import staged

#: Share of the genes that a local fit sees, and places at which fits are made.
SPAN, GRID = 0.3, 64


def normalize_total(expr: DataFrame, target: float = 1e4, known: str | None = None) -> DataFrame:
    """value * target / the cell's total, that of the column `known` where one is named; a total of zero counts as one."""
    total = F.col(known) if known else F.sum("value").over(Window.partitionBy("cell_id"))
    return expr.withColumn("value", F.col("value") * target / F.when(total == 0, 1.0).otherwise(total))


def log_normalize(expr: DataFrame, target: float = 1e4, known: str | None = None) -> DataFrame:
    return normalize_total(expr, target, known).withColumn("value", F.log1p("value"))


def gene_stats(expr: DataFrame, n_cells: int | None = None) -> DataFrame:
    """gene_id, n_cells, mean, var (sample) over all cells, zeros included. Without `n_cells` the cells
    with values count."""
    sums = expr.groupBy("gene_id").agg(F.count_if(F.col("value") != 0).alias("n_cells"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    if n_cells is None:
        sums = sums.crossJoin(F.broadcast(expr.agg(F.countDistinct("cell_id").alias("n"))))
    else:
        sums = sums.withColumn("n", F.lit(n_cells))
    mean = F.col("s") / F.col("n")
    return sums.select("gene_id", "n_cells", mean.alias("mean"), ((F.col("ss") - F.col("n") * mean * mean) / (F.col("n") - 1)).alias("var"))


def gene_nonzero_mean(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """Each gene's mean of normalised values above zero."""
    return normalize_total(expr, target).where("value > 0").groupBy("gene_id").agg(F.avg("value").alias("mean"))


def gene_zero_rate(expr: DataFrame) -> DataFrame:
    n = expr.agg(F.countDistinct("cell_id").alias("n"))
    return expr.where("value <> 0").groupBy("gene_id").agg(F.count(F.lit(1)).alias("nnz")).crossJoin(F.broadcast(n)).select("gene_id", (1 - F.col("nnz") / F.col("n")).alias("zero_rate"))


def zscore_by_gene(values: DataFrame) -> DataFrame:
    """(value - mean) / (sample deviation + 1e-6) over the rows given; 0 where there is none."""
    stats = values.groupBy("gene_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return values.join(stats, "gene_id").withColumn("value", F.coalesce((F.col("value") - F.col("m")) / (F.col("s") + 1e-6), F.lit(0.0))).drop("m", "s")


def local_trend(points: DataFrame, span: float = SPAN, grid: int = GRID) -> DataFrame:
    """`points` (with x, y) and `fit`, y's local trend on x: at `grid` even steps of x a quadratic is fitted to the
    nearest `span` of the points, weighted by (1 - (distance / reach)^3)^3; between two of them their quadratics are
    blended. The driver sees a few numbers for each place of the grid."""
    points = staged(points, "points")
    n = points.count()
    if n == 0:
        return points.withColumn("fit", F.lit(None).cast("double"))
    low, high, mean = points.agg(F.min("x"), F.max("x"), F.avg("y")).first()
    places = np.unique(low + (high - low) * np.arange(grid) / (grid - 1))
    nearest = min(n, max(3, int(n * span + 1e-5)))
    listed = F.array(*[F.lit(float(g)) for g in places])
    apart = staged(points.select("x", "y", F.posexplode(listed).alias("j", "g")).select("j", "y", (F.col("x") - F.col("g")).alias("d")), "apart")
    reach = order_statistics(apart.select("j", F.abs("d").alias("d")), "j", "d", [F.lit(nearest - 1)]).select("j", F.element_at("found", F.lit(nearest - 1).cast("long")).alias("h"))
    far = staged(reach.select("j", F.when(F.col("h") > 0, F.col("h")).otherwise(1.0).alias("h")), "reach")
    u = F.col("d") / F.col("h")
    w = F.pow(1 - F.pow(F.abs(u), F.lit(3.0)), F.lit(3.0))
    near = apart.join(far, "j").where(F.abs("d") < F.col("h")).select("j", "h", "y", u.alias("u"), w.alias("w"))
    power = lambda i: F.col("w") * F.pow("u", F.lit(float(i)))
    sums = near.groupBy("j", "h").agg(*[F.sum(power(i)).alias(f"s{i}") for i in range(5)], *[F.sum(power(i) * F.col("y")).alias(f"t{i}") for i in range(3)])
    # A row for each place of the grid.
    rows = {r["j"]: r for r in sums.collect()}
    fits = []
    for j in range(len(places)):
        if j not in rows:  # no point nearer than the farthest of a few: their mean
            rows[j] = {"h": 1.0, "t0": mean, **{f"s{i}": float(i == 0) for i in range(5)}, "t1": 0.0, "t2": 0.0}
        r = rows[j]
        matrix = np.array([[r[f"s{a + b}"] for b in range(3)] for a in range(3)])
        c = np.linalg.lstsq(matrix, np.array([r[f"t{a}"] for a in range(3)]), rcond=1e-12)[0]
        fits.append((float(places[j]), float(r["h"]), *map(float, c)))
    # A row for each span between two places: where it begins and ends, and the quadratics of both ends.
    pairs = list(zip(fits, fits[1:])) or [(fits[0], fits[0])]
    spans = [(-math.inf if i == 0 else a[0], math.inf if i == len(pairs) - 1 else b[0], *a, *b) for i, (a, b) in enumerate(pairs)]
    names = [f"_{side}{c}" for side in "ab" for c in ("g", "h", "c0", "c1", "c2")]
    table = points.sparkSession.createDataFrame(spans, ", ".join(f"{c} double" for c in ("_from", "_to", *names)))
    own = points.join(F.broadcast(table), (F.col("x") >= F.col("_from")) & (F.col("x") < F.col("_to")))

    def value(side: str) -> Column:
        v = (F.col("x") - F.col(f"_{side}g")) / F.col(f"_{side}h")
        return F.col(f"_{side}c0") + F.col(f"_{side}c1") * v + F.col(f"_{side}c2") * v * v

    width = F.col("_bg") - F.col("_ag")
    t = F.when(width > 0, (F.col("x") - F.col("_ag")) / width).otherwise(0.0)
    return own.withColumn("fit", (1 - t) * value("a") + t * value("b")).drop("_from", "_to", *names)


def highly_variable(expr: DataFrame, n: int, force: DataFrame | None = None) -> DataFrame:
    """The n genes of greatest standardised variance, and those of `force`.

    The variance expected of a mean is the local trend of log10 variance on log10 mean over the genes; values
    are standardised by it and clipped at the root of the number of cells.
    """
    n_cells = expr.agg(F.countDistinct("cell_id").alias("n"))
    stats = gene_stats(expr).where("mean > 0 and var > 0").select("gene_id", "mean", F.log10("mean").alias("x"), F.log10("var").alias("y"))
    expected = local_trend(stats).select("gene_id", "mean", F.sqrt(F.pow(F.lit(10.0), F.col("fit"))).alias("sd"))
    z = F.least((F.col("value") - F.col("mean")) / F.col("sd"), F.sqrt("n"))
    zero = F.greatest(-F.col("mean") / F.col("sd"), -F.sqrt("n"))
    parts = expr.where("value <> 0").join(expected, "gene_id").crossJoin(F.broadcast(n_cells)).groupBy("gene_id", "mean", "sd", "n").agg(F.sum(z * z).alias("ss"), F.count(F.lit(1)).alias("k"))
    score = parts.select("gene_id", ((F.col("ss") + (F.col("n") - F.col("k")) * zero * zero) / (F.col("n") - 1)).alias("score"))
    top = score.orderBy(F.desc(F.round("score", 9)), "gene_id").limit(n).select("gene_id")
    return top if force is None else top.union(force.select("gene_id")).distinct()
