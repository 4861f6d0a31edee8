"""Queries on the cells x genes matrix: sources, quality control, normalisation and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialis.functions.scalars import hashed_sql
from spatialis.operators import normalize as N
from spatialis.operators import qc as Q
from spatialis.operators import sampling as M
from spatialis.operators import tokens as T
from spatialis.plans.registry import query
from spatialis.sources import tables
from spatialis.sources.standins import standin

NORM = "norm as (select cell_id, gene_id, value * 1e4 / sum(value) over (partition by cell_id) as value from expr)"
MEAN = "gene_mean as (select gene_id, avg(value) as mean from norm where value > 0 group by gene_id)"
RANKED = f"""{NORM}, {MEAN},
scaled as (select n.cell_id, n.gene_id, n.value, round(n.value / m.mean, 9) as scaled, g.homo_connect_id, g.gene_type_id, g.ensembl_id from norm n join gene_mean m using (gene_id) join genes g using (gene_id) where m.mean <> 0),
tok as (select * from (select *, (row_number() over (partition by cell_id order by scaled desc, gene_id) - 1)::int as pos from scaled where scaled > 0) where pos < 4096)"""


def _ranked(spark, d, n=T.MAX_LENGTH):
    expr, genes = standin(spark, d, "expr"), standin(spark, d, "genes")
    return T.token_long(expr, genes, N.gene_nonzero_mean(expr), max_length=n)


@query("S1_read_expr", "select cell_id, count(*) as n_genes, sum(value) as total from expr group by cell_id", "expr")
def s1(spark, d):
    return standin(spark, d, "expr").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_genes"), F.sum("value").alias("total"))


@query("S2_read_genes", "select gene_id, ensembl_id, gene_symbol, homo_connect_id, gene_type_id from genes", "genes")
def s2(spark, d):
    return standin(spark, d, "genes")


@query("S3_read_gene_mean", f"with {NORM}, {MEAN} select 'MERFISH' as assay, gene_id, round(mean, 6) as mean from gene_mean", "expr")
def s3(spark, d):
    means = N.gene_nonzero_mean(standin(spark, d, "expr"))
    every = means.crossJoin(F.broadcast(spark.createDataFrame([("MERFISH", False), ("STEREO", False), ("STEREO", True)], "assay string, metacell boolean")))
    return tables.read_gene_mean(every, "merfish", metacell=True).select(F.lit("MERFISH").alias("assay"), "gene_id", F.round("mean", 6).alias("mean"))


@query("F1_filter_cells_min_genes", "select * from expr where cell_id in (select cell_id from expr where value > 0 group by cell_id having count(*) >= 40)", "expr")
def f1(spark, d):
    return Q.filter_cells_min_genes(standin(spark, d, "expr"), 40)


@query("F2_filter_genes_min_cells", "with a as (select * from expr where cell_id in (select cell_id from expr where value > 0 group by cell_id having count(*) >= 40)) select * from a where gene_id in (select gene_id from a where value > 0 group by gene_id having count(*) >= 15)", "expr")
def f2(spark, d):
    return Q.filter_genes_min_cells(f1(spark, d), 15)


@query("F3_filter_cells_min_counts", "select * from expr where cell_id in (select cell_id from expr group by cell_id having sum(value) >= 1000)", "expr")
def f3(spark, d):
    return Q.filter_cells_min_counts(standin(spark, d, "expr"), 1000)


@query("F4_clean_batches", "with g as (select c.* from cells c where cell_id in (select cell_id from expr group by cell_id having sum(value) >= 500)) select * from g where slice in (select slice from g group by slice having count(*) >= 20)", "cells", "expr")
def f4(spark, d):
    return Q.clean_batches(standin(spark, d, "cells"), standin(spark, d, "expr"), "slice", 500, 20)


@query("F5_filter_split", "select * from cells where platform = 'XENIUM'", "cells")
def f5(spark, d):
    return Q.where_all(standin(spark, d, "cells"), {"platform": "XENIUM"})


@query("F6_filter_finite_coords", "select cell_id, case when cell_id % 7 = 0 then 'nan'::double else x end as x, case when cell_id % 11 = 0 then null else y end as y from cells where cell_id % 7 <> 0 and cell_id % 11 <> 0", "cells")
def f6(spark, d):
    cells = standin(spark, d, "cells").select("cell_id", F.when(F.col("cell_id") % 7 == 0, float("nan")).otherwise(F.col("x")).alias("x"), F.when(F.col("cell_id") % 11 != 0, F.col("y")).alias("y"))
    return Q.filter_finite_coords(cells)


@query("F7_check_ensembl", "select gene_id, ensembl_id from genes where ensembl_id like 'ENS%'", "genes")
def f7(spark, d):
    return Q.check_ensembl(standin(spark, d, "genes")).select("gene_id", "ensembl_id")


@query("F8_filter_vocab", "select * from expr where gene_id in (select gene_id from genes where gene_type_id < 10)", "expr", "genes")
def f8(spark, d):
    return Q.filter_vocab(standin(spark, d, "expr"), standin(spark, d, "genes").where("gene_type_id < 10"))


@query("F9_where_all", "select * from cells where slice = 3 and cell_type = 'BUILDING'", "cells")
def f9(spark, d):
    return Q.where_all(standin(spark, d, "cells"), {"slice": 3, "cell_type": "BUILDING"})


@query("F10_drop_unassigned", "select cell_id, case when cell_id % 3 = 0 then 'unassigned' else cell_type end as pred from cells where cell_id % 3 <> 0", "cells")
def f10(spark, d):
    return Q.drop_unassigned(standin(spark, d, "cells").select("cell_id", F.when(F.col("cell_id") % 3 == 0, "unassigned").otherwise(F.col("cell_type")).alias("pred")))


@query("F11_drop_zero_mean_genes", f"with {NORM}, {MEAN} select gene_id, round(case when gene_id % 5 = 0 then 0 else mean end, 6) as mean from gene_mean where gene_id % 5 <> 0", "expr")
def f11(spark, d):
    m = N.gene_nonzero_mean(standin(spark, d, "expr")).withColumn("mean", F.when(F.col("gene_id") % 5 == 0, 0.0).otherwise(F.col("mean")))
    return Q.drop_zero_mean_genes(m).withColumn("mean", F.round("mean", 6))


@query("F12_select_obs", "select cell_id, slice, platform from cells", "cells")
def f12(spark, d):
    return Q.select_obs(standin(spark, d, "cells"), ["cell_id", "slice", "brain_region", "platform"])


@query("F13_marker_cutoff", "select class, gene_id, round(weight, 6) as weight from markers where weight > 2.6", "markers")
def f13(spark, d):
    return Q.marker_cutoff(standin(spark, d, "markers"), 2.6).withColumn("weight", F.round("weight", 6))


@query("F14_drop_other_types", "select cell_id, case when cell_type = 'BUILDING' then 'Others' else cell_type end as cell_type from cells where cell_type <> 'BUILDING'", "cells")
def f14(spark, d):
    return Q.drop_other_types(standin(spark, d, "cells").select("cell_id", F.when(F.col("cell_type") == "BUILDING", "Others").otherwise(F.col("cell_type")).alias("cell_type")))


@query("P1_default_obs", "select cell_id, slice::varchar as slice, region, 'unknown' as brain_region from cells", "cells")
def p1(spark, d):
    return Q.default_obs(standin(spark, d, "cells")).select("cell_id", F.col("slice").cast("string").alias("slice"), "region", "brain_region")


@query("P2_xy_from_spatial", "select cell_id, case when platform = 'STARMAP' then 0 else x + 1 end as x, case when platform = 'STARMAP' then 0 else y + 2 end as y from cells", "cells")
def p2(spark, d):
    cells = standin(spark, d, "cells").select("cell_id", "platform", "x", "y", F.array(F.col("x") + 1, F.col("y") + 2).alias("spatial"))
    return Q.xy_from_spatial(cells, F.when(F.col("platform") == "STARMAP", "snRNA").otherwise(F.col("platform"))).select("cell_id", "x", "y")


@query("P3_encode_codes", "select cell_id, case when cell_id % 2 = 0 then 3 else 4 end::int as specie_token, case platform when 'MERFISH' then 7 when 'XENIUM' then 8 when 'STARMAP' then 9 else 10 end::int as assay_token from cells", "cells")
def p3(spark, d):
    species = F.when(F.col("cell_id") % 2 == 0, "human").otherwise("mouse")
    return Q.encode_codes(standin(spark, d, "cells"), species, F.col("platform")).select("cell_id", "specie_token", "assay_token")


@query("P4_composite_region", "select slice, cell_type, count(*) as n from cells group by slice, cell_type", "cells")
def p4(spark, d):
    return Q.region_source(standin(spark, d, "cells")).groupBy(F.col("brain_region").cast("long").alias("slice"), F.col("brain_region_main").alias("cell_type")).agg(F.count(F.lit(1)).alias("n"))


@query("P5_region_source", "select cell_id, slice::varchar as brain_region, slice::varchar as brain_region_main from cells", "cells")
def p5(spark, d):
    return Q.region_source(standin(spark, d, "cells"), absolute=True).select("cell_id", "brain_region", "brain_region_main")


@query("P6_widen_types", "select vec_id, label::bigint as label, role from vec", "vec")
def p6(spark, d):
    return Q.widen_types(standin(spark, d, "vec").select("vec_id", "label", "role"))


@query("P9_mark_injected", "select cell_id, true as injected, slice as injected_from_slice, cell_type as injected_celltype from cells where slice = 1", "cells")
def p9(spark, d):
    return Q.mark_injected(standin(spark, d, "cells").where("slice = 1"), F.col("slice"), F.col("cell_type")).select("cell_id", "injected", "injected_from_slice", "injected_celltype")


@query("A1_normalize_total", f"with {NORM} select cell_id, gene_id, round(value, 6) as value from norm", "expr")
def a1(spark, d):
    return N.normalize_total(standin(spark, d, "expr")).withColumn("value", F.round("value", 6))


@query("A2_log_normalize", f"with {NORM} select cell_id, gene_id, round(ln(1 + value), 6) as value from norm", "expr")
def a2(spark, d):
    return N.log_normalize(standin(spark, d, "expr")).withColumn("value", F.round("value", 6))


STATS = "stats as (select gene_id, count(*) as n_cells, sum(value) / n as mean, (sum(value * value) - n * (sum(value) / n) * (sum(value) / n)) / (n - 1) as var from expr, (select count(distinct cell_id) as n from expr) group by gene_id, n)"


@query("A3_gene_stats", f"with {STATS} select gene_id, n_cells, round(mean, 6) as mean, round(var, 6) as var from stats", "expr")
def a3(spark, d):
    return N.gene_stats(standin(spark, d, "expr")).withColumns({"mean": F.round("mean", 6), "var": F.round("var", 6)})


@query("A4_gene_nonzero_mean", f"with {NORM}, {MEAN} select gene_id, round(mean, 6) as mean from gene_mean", "expr")
def a4(spark, d):
    return N.gene_nonzero_mean(standin(spark, d, "expr")).withColumn("mean", F.round("mean", 6))


@query("A14_gene_zero_rate", "select gene_id, round(1 - count(*) / (select count(distinct cell_id) from expr), 6) as zero_rate from expr group by gene_id", "expr")
def a14(spark, d):
    return N.gene_zero_rate(standin(spark, d, "expr")).withColumn("zero_rate", F.round("zero_rate", 6))


@query("W7_zscore_by_gene", "select cell_id, gene_id, round(coalesce((value - avg(value) over g) / (stddev_samp(value) over g + 1e-6), 0), 6) + 0.0 as value from expr window g as (partition by gene_id)", "expr")
def w7(spark, d):
    return N.zscore_by_gene(standin(spark, d, "expr")).select("cell_id", "gene_id", F.round("value", 6).alias("value"))


_DET = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"
_COEFFICIENT = lambda k: f"{_DET(*[[f't{i}' if j == k else f's{i + j}' for j in range(3)] for i in range(3)])} / {_DET(*[[f's{i + j}' for j in range(3)] for i in range(3)])} as c{k}"
_CURVE = lambda f: f"({f}.c0 + {f}.c1 * ((p.x - {f}.g) / {f}.h) + {f}.c2 * ((p.x - {f}.g) / {f}.h) ^ 2)"
HVG_SQL = f"""with total as (select cell_id, sum(value) as t from expr group by 1),
v as (select cell_id, gene_id, ln(1 + value * 1e4 / t) as value from expr join total using (cell_id)),
c as (select count(distinct cell_id)::double as n from v),
stats as (select gene_id, sum(value) / n as mean, (sum(value * value) - n * (sum(value) / n) ^ 2) / (n - 1) as var from v, c group by gene_id, n),
p as (select gene_id, mean, log10(mean) as x, log10(var) as y from stats where mean > 0 and var > 0),
grid as (select g, row_number() over (order by g) - 1 as j from (select distinct lo + (hi - lo) * unnest(range(64)) / 63 as g from (select min(x) as lo, max(x) as hi from p))),
reach as (select j, g, list_sort(list(abs(x - g)))[least(count(*), greatest(3, floor(count(*) * 0.3 + 1e-5)::bigint))] as h from p, grid group by 1, 2),
near as (select j, g, h, (x - g) / h as u, y, (1 - abs((x - g) / h) ^ 3) ^ 3 as w from p, reach where abs(x - g) < h),
sums as (select j, g, h, {', '.join(f'sum(w * u ^ {i}) as s{i}' for i in range(5))}, {', '.join(f'sum(w * u ^ {i} * y) as t{i}' for i in range(3))} from near group by 1, 2, 3),
fits as (select j, g, h, {', '.join(_COEFFICIENT(k) for k in range(3))} from sums),
placed as (select p.*, least((select max(j) from grid) - 1, (select max(j) from grid where g <= p.x)) as j from p),
fitted as (select gene_id, mean, sqrt(power(10.0, (1 - (p.x - a.g) / (b.g - a.g)) * {_CURVE('a')} + (p.x - a.g) / (b.g - a.g) * {_CURVE('b')})) as sd from placed p join fits a on a.j = p.j join fits b on b.j = p.j + 1),
parts as (select gene_id, mean, sd, n, sum(least((value - mean) / sd, sqrt(n)) ^ 2) as ss, count(*) as k from v join fitted using (gene_id), c where value <> 0 group by 1, 2, 3, 4)
select gene_id from parts order by round((ss + (n - k) * greatest(-mean / sd, -sqrt(n)) ^ 2) / (n - 1), 9) desc, gene_id limit 200"""


@query("L1_hvg", HVG_SQL, "expr")
def l1(spark, d):
    return N.highly_variable(N.log_normalize(standin(spark, d, "expr")), 200)


@query("J1_align_genes", f"with {NORM}, {MEAN} select n.cell_id, n.gene_id, g.homo_connect_id, round(m.mean, 6) as mean from norm n join gene_mean m using (gene_id) join genes g using (gene_id)", "expr", "genes")
def j1(spark, d):
    expr = standin(spark, d, "expr")
    return T.align_genes(expr, standin(spark, d, "genes"), N.gene_nonzero_mean(expr)).select("cell_id", "gene_id", "homo_connect_id", F.round("mean", 6).alias("mean"))


@query("W1_rank_tokens", f"with {RANKED} select cell_id, gene_id, pos from tok", "expr", "genes")
def w1(spark, d):
    return _ranked(spark, d).select("cell_id", "gene_id", "pos")


@query("T1_top_tokens", f"with {RANKED} select cell_id, gene_id, pos from tok where pos < 5", "expr", "genes")
def t1(spark, d):
    return _ranked(spark, d, 5).select("cell_id", "gene_id", "pos")


@query("T6_max_rank", f"with {RANKED} select cell_id, pos, gene_id + 20 as token from tok where pos < 8 and gene_id + 20 <> 1", "expr", "genes")
def t6(spark, d):
    return _ranked(spark, d).where((F.col("pos") < 8) & (F.col("token") != T.PAD)).select("cell_id", "pos", "token")


@query("K1_tokenize", f"""with {RANKED} select cell_id, list(gene_id + 20 order by pos) as "X", list(homo_connect_id + 1 order by pos) as "X_connect_comp", list(gene_type_id + 1 order by pos) as "X_rna_type", list(0::int order by pos) as "X_deviation_bin", list(round(value, 6) order by pos) as "X_exp" from tok group by cell_id""", "expr", "genes")
def k1(spark, d):
    return T.token_rows(_ranked(spark, d)).withColumn("X_exp", F.transform("X_exp", lambda v: F.round(v, 6)))


@query("P7_truncate_context", f"""with {RANKED} select cell_id, list(gene_id + 20 order by pos) filter (pos < 6) as "X" from tok group by cell_id""", "expr", "genes")
def p7(spark, d):
    return T.truncate_context(T.token_rows(_ranked(spark, d)), ["X"], 6).select("cell_id", "X")


@query("P8_prefix_aux", f"""with {RANKED} select cell_id, list_concat([3::bigint, 8::bigint, 15::bigint], list(gene_id + 20 order by pos)) as "X", list_concat([0::bigint, 0::bigint, 0::bigint], list(homo_connect_id + 1 order by pos)) as "X_connect_comp" from tok group by cell_id""", "expr", "genes")
def p8(spark, d):
    return T.prefix_aux(T.token_rows(_ranked(spark, d)), F.lit(3), F.lit(8), F.lit(T.DENSITY), ["X_connect_comp"]).select("cell_id", "X", "X_connect_comp")


_M = lambda k: hashed_sql("cell_id", "pos", salt=f"mask-{k}")
MASKED = f"""masked as (select cell_id, pos, token, hit, case when not hit then token when {_M('random')} < 0.1 then other when {_M('same')} < 0.1 then token else 0 end as masked
from (select cell_id, pos, gene_id + 20 as token, (gene_id + 20 > 20 and {_M('hit')} < 0.15) as hit, (floor({_M('which')} * 2999) + 21)::bigint as other from tok))"""


@query("M9_mask_tokens", f"with {RANKED}, {MASKED} select cell_id, pos, token, masked::bigint as masked, (case when hit then 0 else 1 end)::int as mask, masked = 1 as attention from masked", "expr", "genes")
def m9(spark, d):
    return T.mask_tokens(_ranked(spark, d), 3000).select("cell_id", "pos", "token", "masked", "mask", "attention")


MODEL_INPUT_SQL = f"""with {RANKED}, {MASKED} select cell_id, list(masked::bigint order by pos) as masked_indices, list((case when hit then 0 else 1 end)::int order by pos) as mask, list(token order by pos) as real_indices, list(masked = 1 order by pos) as attention_mask, (cell_id // 100)::bigint as batch_id from masked where pos < 1000 group by cell_id"""


@query("K3_model_input", MODEL_INPUT_SQL, "expr", "genes")
def k3(spark, d):
    return T.model_input(_ranked(spark, d), 3000, 100)


for _mode, _sql in (("linear", "1 - pos / n"), ("decay", "power(0.998, pos)"), ("softmax", "exp(-pos / 300.0) / sum(exp(-pos / 300.0)) over (partition by cell_id) * n")):

    @query(f"W3_rank_weights_{_mode}", f"with {RANKED} select cell_id, pos, round({_sql}, 6) as weight from (select *, count(*) over (partition by cell_id)::double as n from tok)", "expr", "genes")
    def w3(spark, d, mode=_mode):
        return T.rank_weights(_ranked(spark, d), mode).select("cell_id", "pos", F.round("weight", 6).alias("weight"))


@query("W3_rank_weights_fixed", f"with {RANKED} select cell_id, pos, round(1 - pos / 4096.0, 6) as weight from tok", "expr", "genes")
def w3fixed(spark, d):
    return T.rank_weights(_ranked(spark, d), "linear", T.MAX_LENGTH).select("cell_id", "pos", F.round("weight", 6).alias("weight"))


@query("B3_expr_weights", f"with {RANKED} select cell_id, pos, round(case when pos = 2 then 0.02 when pos < 3 then 0 else log2(1 + value) / sum(case when pos >= 3 then log2(1 + value) else 0 end) over (partition by cell_id) end, 6) as weight from tok", "expr", "genes")
def b3(spark, d):
    return T.expr_weights(_ranked(spark, d)).select("cell_id", "pos", F.round("weight", 6).alias("weight"))


@query("J5_token_meta", f"with {RANKED} select t.cell_id, t.pos, t.gene_id + 20 as token, coalesce(g.homo_connect_id + 1, 0) as homology, coalesce(g.gene_type_id + 1, 0) as rna_type, false as is_pad from tok t left join (select * from genes where gene_id % 2 = 0) g using (gene_id)", "expr", "genes")
def j5(spark, d):
    return T.token_meta(_ranked(spark, d), standin(spark, d, "genes").where("gene_id % 2 = 0"))


@query("J6_token_to_ensembl", f"with {RANKED} select t.cell_id, t.pos, coalesce(g.ensembl_id, 'UNKNOWN') as ensembl_id from tok t left join (select * from genes where gene_id % 2 = 0) g using (gene_id)", "expr", "genes")
def j6(spark, d):
    return T.token_to_ensembl(_ranked(spark, d), standin(spark, d, "genes").where("gene_id % 2 = 0")).select("cell_id", "pos", "ensembl_id")


@query("W2_assign_batches", "select cell_id, slice, ((row_number() over (partition by slice order by cell_id) - 1) // 10)::int as chunk from cells", "cells")
def w2(spark, d):
    return T.assign_batches(standin(spark, d, "cells"), "slice", 10).select("cell_id", "slice", "chunk")


_H = lambda salt, *k: hashed_sql(*(k or ("cell_id",)), salt=salt)


@query("M1_split_by_slice", f"select cell_id, case when row_number() over (partition by slice order by {_H('split')}, cell_id) <= greatest(1, floor(0.1 * count(*) over (partition by slice))) then 'valid' else 'train' end as split from cells", "cells")
def m1(spark, d):
    return M.split_by_slice(standin(spark, d, "cells"), "slice", 0.1).select("cell_id", "split")


@query("M2_split_random", f"select cell_id, case when {_H('random-42')} < 0.1 then 'valid' else 'train' end as split from cells", "cells")
def m2(spark, d):
    return M.split_random(standin(spark, d, "cells"), 0.1, 42).select("cell_id", "split")


@query("M2_split_random_exact", f"select cell_id, case when row_number() over (order by {_H('random-42')}, cell_id) <= ceil(round(0.1 * count(*) over (), 9)) then 'valid' else 'train' end as split from cells", "cells")
def m2e(spark, d):
    return M.split_random(standin(spark, d, "cells"), 0.1, 42, exact=True).select("cell_id", "split")


@query("M3_subsample_fix", f"select cell_id, cell_type from (select *, row_number() over (partition by cell_type order by {_H('subsample')}, cell_id) as r, count(*) over (partition by cell_type) as n from cells) where r <= least(n, floor(least(50, n) * case when cell_type = 'BUILDING' then 2 else 1 end))", "cells")
def m3(spark, d):
    return M.subsample_fix(standin(spark, d, "cells"), "cell_type", 50, {"BUILDING": 2.0}).select("cell_id", "cell_type")


@query("M4_subsample_prop", f"with s as (select cell_type, count(*) as n from cells group by 1), w as (select cell_type, n, sqrt(n / (select sum(n) from s)) as w, (select sum(n) from s) as total from s), t as (select cell_type, least(n, floor(round(w / (select sum(w) from w) * total * 0.2, 6))) as target from w) select cell_id, cell_type from (select *, row_number() over (partition by cell_type order by {_H('subsample')}, cell_id) as r from cells) join t using (cell_type) where r <= target", "cells")
def m4(spark, d):
    return M.subsample_prop(standin(spark, d, "cells"), "cell_type", 0.2, 0.5).select("cell_id", "cell_type")


@query("M6_pick_slice_capped", f"select cell_id, slice from cells where slice = (select slice from (select distinct slice from cells) order by {_H('slice', 'slice')}, slice limit 1) qualify row_number() over (order by {_H('cap')}, cell_id) <= 30", "cells")
def m6(spark, d):
    return M.pick_slice_capped(standin(spark, d, "cells"), "slice", 30).select("cell_id", "slice")


@query("M7_sample_cells_or_ratio", f"select cell_id, slice from (select *, row_number() over (partition by slice order by {_H('cells')}, cell_id) as r, count(*) over (partition by slice) as n from cells) where r <= floor(n * 0.05)", "cells")
def m7(spark, d):
    return M.sample_ratio(standin(spark, d, "cells"), "slice", 0.05).select("cell_id", "slice")


@query("M8_sample_genes_by_sparsity", f"with z as (select gene_id, 1 - count(*) / (select count(distinct cell_id) from expr) as zero_rate from expr group by gene_id), b as (select gene_id, case when zero_rate > 0.95 then 3 when zero_rate > 0.9 then 2 when zero_rate > 0.75 then 1 when zero_rate > 0 then 0 end::int as bin from z) select gene_id, bin from (select *, row_number() over (partition by bin order by {_H('genes', 'gene_id')}, gene_id) as r from b where bin is not null) where r <= 25", "expr")
def m8(spark, d):
    return M.sample_genes_by_sparsity(N.gene_zero_rate(standin(spark, d, "expr"))).select("gene_id", "bin")


@query("M10_holdout_entries", f"with n as (select *, count(*) over (partition by cell_id) as nnz, row_number() over (partition by cell_id order by {_H('holdout', 'cell_id', 'gene_id')}, gene_id) as r from expr) select cell_id, gene_id, case when nnz <= 5 then 'train' when r <= floor(0.1 * nnz) then 'test' when r <= floor(0.1 * nnz) + floor(0.1 * nnz) then 'valid' else 'train' end as part from n", "expr")
def m10(spark, d):
    return M.holdout_entries(standin(spark, d, "expr"), 0.1, 0.1).select("cell_id", "gene_id", "part")


@query("M10_holdout_weighted", f"with n as (select *, count(*) over (partition by cell_id) as nnz, row_number() over (partition by cell_id order by -ln(greatest({_H('holdout', 'cell_id', 'gene_id')}, 1e-12)) / exp(-value / 40.0), gene_id) as r from expr) select cell_id, gene_id, case when nnz <= 5 then 'train' when r <= floor(0.1 * nnz) then 'test' when r <= floor(0.1 * nnz) + floor(0.1 * nnz) then 'valid' else 'train' end as part from n", "expr")
def m10weighted(spark, d):
    return M.holdout_entries(standin(spark, d, "expr"), 0.1, 0.1, scale=40.0).select("cell_id", "gene_id", "part")


@query("M11_mask_entries", f"select cell_id, gene_id, case when {_H('mask-cell')} < 0.5 and {_H('mask-entry', 'cell_id', 'gene_id')} < 0.2 then 0 else value end as value from expr", "expr")
def m11(spark, d):
    return M.mask_entries(standin(spark, d, "expr"), 0.5, 0.2)


@query("M11_mask_renormalized", f"select cell_id, gene_id, round(case when {_H('mask-cell')} < 0.5 and {_H('mask-entry', 'cell_id', 'gene_id')} < 0.2 then 0 when {_H('mask-cell')} < 0.5 then ln(1 + value) - ln(0.8) else ln(1 + value) end, 6) as value from expr", "expr")
def m11r(spark, d):
    logs = standin(spark, d, "expr").withColumn("value", F.log1p("value"))
    return M.mask_entries(logs, 0.5, 0.2, renormalize=True).withColumn("value", F.round("value", 6))


@query("M12_drop_nodes", f"select cell_id from cells qualify row_number() over (order by {_H('nodes')}, cell_id) <= least(200, (select floor(count(*) * 0.7) from cells))", "cells")
def m12(spark, d):
    return M.drop_nodes(standin(spark, d, "cells"), 0.3, 200).select("cell_id")


@query("M12_drop_nodes_aligned", f"with k as (select cell_id from cells qualify row_number() over (order by {_H('nodes')}, cell_id) <= least(200, (select floor(count(*) * 0.7) from cells))) select * from expr where cell_id in (select cell_id from k)", "cells", "expr")
def m12a(spark, d):
    return M.keep_aligned(M.drop_nodes(standin(spark, d, "cells"), 0.3, 200), standin(spark, d, "expr"))[0]


@query("M13_shuffle_rows", "select cell_id, slice from cells", "cells")
def m13(spark, d):
    return M.shuffle_rows(standin(spark, d, "cells"), ["slice"]).select("cell_id", "slice")
