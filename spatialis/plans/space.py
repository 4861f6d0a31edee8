"""Queries on coordinates and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialis.operators import spatial as S
from spatialis.plans.registry import query
from spatialis.sources.standins import standin

D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
EDGES = f"edges as (select * from (select a.slice, a.cell_id, b.cell_id as nbr_id, {D2} as dist2, row_number() over (partition by a.cell_id order by {D2}, b.cell_id) as rank from cells a join cells b on a.slice = b.slice) where rank <= 5)"
NBR = "nbr as (select n.cell_id, e.gene_id, sum(e.value) / n.k as nbr_mean from (select *, count(*) over (partition by cell_id) as k from edges) n join expr e on e.cell_id = n.nbr_id group by n.cell_id, e.gene_id, n.k)"
DEV = "dev as (select coalesce(e.cell_id, n.cell_id) as cell_id, coalesce(e.gene_id, n.gene_id) as gene_id, round(coalesce(e.value, 0) - coalesce(n.nbr_mean, 0), 6) as deviation from expr e full join nbr n on e.cell_id = n.cell_id and e.gene_id = n.gene_id)"
ORDERED = "(a.slice = b.slice and a.cell_type = b.cell_type)"


def _edges(spark, d, k=5, part=True):
    return S.knn_in_group(standin(spark, d, "cells"), k, ["slice"], part=part)


@query("N1_knn_in_group", f"with {EDGES} select slice, cell_id, nbr_id, rank::int as rank, dist2 from edges", "cells")
def n1(spark, d):
    return _edges(spark, d, part=False)


@query("J9_knn_join", f"select a.slice, a.cell_type, a.cell_id, b.cell_id as nbr_id, (row_number() over (partition by a.cell_id order by {D2}, b.cell_id))::int as rank, {D2} as dist2 from cells a join cells b on {ORDERED} qualify rank <= 50", "cells")
def j9(spark, d):
    return S.knn_in_group(standin(spark, d, "cells"), 50, ["slice", "cell_type"])


@query("N2_to_microns", f"with m as (select * from cells where platform = 'MERFISH'), n as (select avg(sqrt(dist2)) as d from (select {D2} as dist2, row_number() over (partition by a.cell_id order by {D2}, b.cell_id) as r from m a join m b on a.slice = b.slice) where r = 2) select cell_id, round(x * f, 6) as x_um, round(y * f, 6) as y_um from (select *, case platform when 'MERFISH' then 20.0 / (select d from n) when 'XENIUM' then 0.2 when 'STARMAP' then 0.1 else 10.0 end as f from cells)", "cells")
def n2(spark, d):
    return S.to_microns(standin(spark, d, "cells"), ["slice"]).select("cell_id", F.round("x_um", 6).alias("x_um"), F.round("y_um", 6).alias("y_um"))


@query("J10_radius_join", f"select a.slice, a.cell_id, b.cell_id as nbr_id, {D2} as dist2 from cells a join cells b on a.slice = b.slice and {D2} <= 10000", "cells")
def j10(spark, d):
    return S.radius_pairs(standin(spark, d, "cells"), 100, ["slice"])


@query("N3_density_token", f"with den as (select a.slice, a.cell_id, count(*) as density, ln(1 + count(*)) as ld from cells a join cells b on a.slice = b.slice and {D2} <= 40000 group by 1, 2), e as (select slice, greatest(0, min(ld)) as lo, max(ld) as hi from den group by 1) select slice, cell_id, density, (case when hi = lo then 0 else greatest(0, least(4, ceil(round((ld - lo) / ((hi - lo) / 5), 9)) - 1)) end)::int as density_token from den join e using (slice)", "cells")
def n3(spark, d):
    return S.density_token(standin(spark, d, "cells"), 200)


@query("N4_neighbor_mean", f"with {EDGES}, {NBR} select cell_id, gene_id, round(nbr_mean, 6) as nbr_mean from nbr", "cells", "expr")
def n4(spark, d):
    return S.neighbor_mean(_edges(spark, d), standin(spark, d, "expr")).withColumn("nbr_mean", F.round("nbr_mean", 6))


@query("N5_deviation", f"with {EDGES}, {NBR}, {DEV} select cell_id, gene_id, deviation from dev", "cells", "expr")
def n5(spark, d):
    return S.deviation(_edges(spark, d), standin(spark, d, "expr"))


@query("N5_deviation_low", f"with {EDGES}, {NBR} select coalesce(e.cell_id, n.cell_id) as cell_id, coalesce(e.gene_id, n.gene_id) as gene_id, round(abs(coalesce(e.value, 0) - coalesce(n.nbr_mean, 0)), 6) as deviation from expr e full join nbr n on e.cell_id = n.cell_id and e.gene_id = n.gene_id where coalesce(e.value, 0) >= 2 or coalesce(n.nbr_mean, 0) >= 2", "cells", "expr")
def n5low(spark, d):
    return S.deviation(_edges(spark, d), standin(spark, d, "expr"), absolute=True, low=2.0)


@query("N6_deviation_bin", f"with {EDGES}, {NBR}, {DEV}, q as (select gene_id, list_transform(quantile_cont(deviation, [0.2, 0.4, 0.6, 0.8]), lambda v: round(v, 6)) as q from dev group by 1) select cell_id, gene_id, deviation, (len(list_filter(q.q, lambda v: v < deviation)) + 1)::int as deviation_bin from dev join q using (gene_id)", "cells", "expr")
def n6(spark, d):
    return S.deviation_bin(S.deviation(_edges(spark, d), standin(spark, d, "expr")))


@query("N7_gaussian_smooth", f"with {EDGES}, s as (select avg(sqrt(dist2)) as s from edges where cell_id <> nbr_id), w as (select cell_id, nbr_id, exp(-dist2 / (2 * s * s)) as w from edges, s), t as (select *, w / sum(w) over (partition by cell_id) as p from w) select t.cell_id, e.gene_id, round(sum(t.p * e.value), 6) as value from t join expr e on e.cell_id = t.nbr_id group by 1, 2", "cells", "expr")
def n7(spark, d):
    return S.gaussian_smooth(_edges(spark, d), standin(spark, d, "expr")).withColumn("value", F.round("value", 6))


@query("N7_gaussian_smooth_median", f"with {EDGES}, s as (select round(median(sqrt(dist2)), 6) as s from edges where cell_id <> nbr_id), w as (select cell_id, nbr_id, exp(-dist2 / (2 * s * s)) as w from edges, s), t as (select *, w / sum(w) over (partition by cell_id) as p from w) select t.cell_id, e.gene_id, round(sum(t.p * e.value), 6) as value from t join expr e on e.cell_id = t.nbr_id group by 1, 2", "cells", "expr")
def n7median(spark, d):
    return S.gaussian_smooth(_edges(spark, d), standin(spark, d, "expr"), "median").withColumn("value", F.round("value", 6))


@query("A17_minmax_coords", "select cell_id, round((x - min(x) over s) / (max(x) over s - min(x) over s + 1e-8), 6) as x, round((y - min(y) over s) / (max(y) over s - min(y) over s + 1e-8), 6) as y from cells window s as (partition by slice)", "cells")
def a17(spark, d):
    return S.minmax_coords(standin(spark, d, "cells"), "slice").select("cell_id", F.round("x_FOV_px", 6).alias("x"), F.round("y_FOV_px", 6).alias("y"))


GRID = "g as (select cell_id, (case when cell_id % 9 = 0 then null else greatest(0, least(99, floor((x / 1009 * 1.02 - 0.01) * 100)))::int * 100 + greatest(0, least(99, floor((y / 1013 * 1.02 - 0.01) * 100)))::int end)::int as grid from cells)"


def _grid(spark, d):
    cells = standin(spark, d, "cells").select("cell_id", F.when(F.col("cell_id") % 9 == 0, -1.0).otherwise(F.col("x") / 1009).alias("x_FOV_px"), (F.col("y") / 1013).alias("y_FOV_px"))
    return S.spatial_grid(cells).select("cell_id", "grid")


@query("N9_spatial_grid", f"with {GRID} select cell_id, grid from g", "cells")
def n9(spark, d):
    return _grid(spark, d)


_WAVE = lambda g: f"flatten(list_transform(range(4), lambda i: [round(sin({g} / power(10000.0, i / 4.0)), 6) + 0.0, round(cos({g} / power(10000.0, i / 4.0)), 6) + 0.0]))"


@query("N10_sincos_features", f"with {GRID} select cell_id, grid, case when grid is not null then list_concat({_WAVE('(grid // 100)')}, {_WAVE('(grid % 100)')}) end as pe from g", "cells")
def n10(spark, d):
    return S.sincos_features(_grid(spark, d), 16).withColumn("pe", F.when(F.col("grid").isNotNull(), F.transform("pe", lambda x: F.round(x, 6))))
