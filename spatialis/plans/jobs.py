"""Queries on whole jobs, sinks and what SQL can only check in part."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spatialis.operators import genes as G
from spatialis.operators import jobs as J
from spatialis.operators import normalize as N
from spatialis.operators import tokens as T
from spatialis.operators.transfer import centroids, nearest_centroid
from spatialis.plans.matrix import MODEL_INPUT_SQL, RANKED, k3
from spatialis.plans.perturbation import _R, PLAIN, _after
from spatialis.plans.registry import query
from spatialis.sources import tables
from spatialis.sources.staging import shared_folder, staged
from spatialis.sources.standins import standin


def _all(spark, d, *names):
    return [standin(spark, d, n) for n in names]


_GOOD = "c1 as (select * from expr where cell_id in (select cell_id from expr where value > 0 group by 1 having count(*) >= 3)), good as (select * from c1 where gene_id in (select gene_id from c1 where value > 0 group by 1 having count(*) >= 3)), placed as (select *, dense_rank() over (order by cell_type) - 1 as cell_label from cells where cell_id in (select cell_id from good))"
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
K2_SQL = f"""with {_GOOD},
norm as (select cell_id, gene_id, value * 1e4 / sum(value) over (partition by cell_id) as value from good),
gene_mean as (select gene_id, avg(value) as mean from norm where value > 0 group by gene_id),
near as (select * from (select a.cell_id, b.cell_id as nbr_id, row_number() over (partition by a.cell_id order by {_D2}, b.cell_id) as rank from placed a join placed b on a.slice = b.slice and a.cell_label = b.cell_label) where rank <= 50),
nbr as (select n.cell_id, e.gene_id, sum(e.value) / n.k as nbr_mean from (select *, count(*) over (partition by cell_id) as k from near) n join norm e on e.cell_id = n.nbr_id group by n.cell_id, e.gene_id, n.k),
dev as (select coalesce(e.cell_id, n.cell_id) as cell_id, coalesce(e.gene_id, n.gene_id) as gene_id, round(coalesce(e.value, 0) - coalesce(n.nbr_mean, 0), 6) as deviation from norm e full join nbr n on e.cell_id = n.cell_id and e.gene_id = n.gene_id),
q as (select gene_id, list_transform(quantile_cont(deviation, [0.2, 0.4, 0.6, 0.8]), lambda v: round(v, 6)) as q from dev group by 1),
bins as (select cell_id, gene_id, (len(list_filter(q.q, lambda v: v < deviation)) + 1)::int as bin from dev join q using (gene_id)),
pair as (select a.slice, a.cell_id, {_D2} as d2, row_number() over (partition by a.cell_id order by {_D2}, b.cell_id) as r from placed a join placed b on a.slice = b.slice),
unit as (select 20.0 / avg(sqrt(d2)) as f from pair where r = 2),
den as (select slice, cell_id, ln(1 + count(*)) as ld from pair, unit where d2 * f * f <= 22500 group by 1, 2),
edge as (select slice, greatest(0, min(ld)) as lo, max(ld) as hi from den group by 1),
level as (select cell_id, (case when hi = lo then 0 else greatest(0, least(4, ceil(round((ld - lo) / ((hi - lo) / 5), 9)) - 1)) end + 15)::int as density_token from den join edge using (slice)),
scaled as (select n.cell_id, n.gene_id, n.value, round(n.value / m.mean, 9) as scaled, g.homo_connect_id, g.gene_type_id from norm n join gene_mean m using (gene_id) join genes g using (gene_id) where m.mean <> 0),
tok as (select *, row_number() over (partition by cell_id order by scaled desc, gene_id) - 1 as pos from scaled where scaled > 0),
rows as (select t.cell_id, list(t.gene_id + 20 order by pos) as "X", list(homo_connect_id + 1 order by pos) as "X_connect_comp", list(gene_type_id + 1 order by pos) as "X_rna_type", list(bin order by pos) as "X_deviation_bin", list(round(value, 6) order by pos) as "X_exp" from tok t join bins b on b.cell_id = t.cell_id and b.gene_id = t.gene_id group by 1)
select rows.*, slice, region, slice::varchar as brain_region, cell_label::varchar as brain_region_main, placed.x as cell_x, placed.y as cell_y, cell_label, 4 as specie_token, 7 as assay_token, density_token from rows join placed using (cell_id) join level using (cell_id)"""


@query("K2_tokenize_dataset", K2_SQL, "cells", "expr", "genes")
def k2(spark, d):
    return J.tokenize_dataset(*_all(spark, d, "cells", "expr", "genes"), label="cell_type").drop("chunk").withColumn("X_exp", F.transform("X_exp", lambda v: F.round(v, 6)))


@query("L9_prepare_dataset")
def l9(spark, d):
    return J.prepare_dataset(*_all(spark, d, "cells", "expr", "genes", "homology"), 50, force=["T1", "T2"])


@query("N8_spatial_impute")
def n8(spark, d):
    return J.impute_dataset(*_all(spark, d, "cells", "expr"), 6, n_pcs=8)


COS = "list_dot_product(e, c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c, c)))"


@query(
    "L12_celltype_auroc",
    f"with m as (select label, dim, avg(v) as v from (select label, unnest(range(1, 65)) as dim, unnest(embedding)::double as v from vec where role = 'ref') group by 1, 2), cc as (select label as center, list(v order by dim) as c from m group by 1), s as (select q.label, cc.center, round({COS}, 9) as v from (select label, embedding::double[] as e from vec where role = 'query') q, cc), r as (select *, rank() over (partition by center order by v) + (count(*) over (partition by center, v) - 1) / 2.0 as rank from s), t as (select center, label, sum(rank) as r, count(*) as n from r group by 1, 2) select label, center, round((r - n * (n + 1) / 2) / (n * (sum(n) over (partition by center) - n)), 6) as auroc from t",
    "vec",
)
def l12(spark, d):
    vec = standin(spark, d, "vec")
    return J.celltype_auroc(vec.where("role = 'ref'"), vec.where("role = 'query'")).withColumn("auroc", F.round("auroc", 6))


_RANKED_VOTES = """labels as (select cell_id, cell_type as label, slice from cells where cell_id in (select cell_id from expr where value > 0)),
dense as (select l.*, g.gene_id, coalesce(e.value, 0) as value from labels l cross join genes g left join expr e on e.cell_id = l.cell_id and e.gene_id = g.gene_id),
ranked as (select *, rank() over (partition by cell_id order by value) + (count(*) over (partition by cell_id, value) - 1) / 2.0 - (count(*) over (partition by cell_id) + 1) / 2.0 as r from dense),
unit as (select cell_id, label, slice, gene_id, r / sqrt(sum(r * r) over (partition by cell_id)) as r from ranked),
mid as (select label as center, gene_id, avg(r) as c from unit where slice < 12 group by 1, 2),
votes as (select cell_id, label, center, round(sum(r * c), 9) as v from unit join mid using (gene_id) where slice >= 12 group by 1, 2, 3)"""
_AUROC = lambda rows: f"select center, label, (sum(rank) - count(*) * (count(*) + 1) / 2) / (count(*) * (any_value(every) - count(*))) as auroc from (select *, rank() over (partition by center order by v) + (count(*) over (partition by center, v) - 1) / 2.0 as rank, count(*) over (partition by center) as every from {rows}) group by 1, 2"


def _auroc_parts(spark, d):
    expr, cells, genes = _all(spark, d, "expr", "cells", "genes")
    side = lambda test: expr.join(cells.where(test).select("cell_id"), "cell_id", "left_semi")
    return side("slice < 12"), side("slice >= 12"), cells.select("cell_id", F.col("cell_type").alias("label")), genes.count()


@query("L12_celltype_auroc_ranked", f"with {_RANKED_VOTES}, a as ({_AUROC('votes')}) select label, center, round(auroc, 6) as auroc from a", "expr", "cells", "genes")
def l12ranked(spark, d):
    return J.celltype_auroc_ranked(*_auroc_parts(spark, d)).withColumn("auroc", F.round("auroc", 6))


@query("L12_one_vs_best", f"with {_RANKED_VOTES}, a as ({_AUROC('votes')}), o as (select *, row_number() over (partition by center order by round(auroc, 9) desc, label) as i from a), p as (select center, max(label) filter (i = 1) as best, max(label) filter (i = 2) as second from o where i <= 2 group by 1), two as (select v.* from votes v join p using (center) where label in (best, second)), b as ({_AUROC('two')}) select center, best, second, round(auroc, 6) as auroc from b join p using (center) where label = best", "expr", "cells", "genes")
def l12best(spark, d):
    return J.one_vs_best(*_auroc_parts(spark, d)).withColumn("auroc", F.round("auroc", 6))


@query(
    "L14_enrichment_terms",
    "with u as (select gene_id, gene_type_id as set from genes), g as (select gene_id from genes where gene_id % 9 = 0 or gene_type_id = 3 and gene_id % 2 = 0), c as (select count(*) as n, (select count(*) from g) as d from genes), o as (select set, count(*) as size, count(*) filter (gene_id in (select gene_id from g)) as overlap from u group by 1), e as (select *, unnest(range(greatest(overlap, size + d - n), least(size, d) + 1)) as i from o, c where overlap > 0), p as (select set, overlap, size, round(sum(exp(lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) + lgamma(n - size + 1) - lgamma(d - i + 1) - lgamma(n - size - d + i + 1) - lgamma(n + 1) + lgamma(d + 1) + lgamma(n - d + 1))), 12) as p from e group by 1, 2, 3), r as (select *, p * count(*) over () / count(*) over (order by p) as raw from p), q as (select set, overlap, size, p, least(1, min(raw) over (order by p desc)) as q from r) select set, overlap, size, round(p, 6) as p, round(q, 6) as q from q where q < 0.9 order by round(p, 9), set limit 5",
    "genes",
)
def l14terms(spark, d):
    genes = standin(spark, d, "genes")
    listed = genes.where("gene_id % 9 = 0 or gene_type_id = 3 and gene_id % 2 = 0").select("gene_id")
    out = J.enrichment(listed, genes.select("gene_id", F.col("gene_type_id").alias("set")), genes.select("gene_id"), 0.9, 5)
    return out.withColumns({c: F.round(c, 6) for c in ("p", "q")})


@query("L13_cluster_sweep")
def l13(spark, d):
    return J.cluster_sweep(standin(spark, d, "vec"), [5, 10])


@query(
    "L14_enrichment",
    "with u as (select gene_id, gene_type_id as set from genes), g as (select gene_id from genes where gene_id % 9 = 0 or gene_type_id = 3 and gene_id % 2 = 0), c as (select count(*) as n, (select count(*) from g) as d from genes), o as (select set, count(*) as size, count(*) filter (gene_id in (select gene_id from g)) as overlap from u group by 1), e as (select *, unnest(range(greatest(overlap, size + d - n), least(size, d) + 1)) as i from o, c where overlap > 0), p as (select set, overlap, size, round(sum(exp(lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) + lgamma(n - size + 1) - lgamma(d - i + 1) - lgamma(n - size - d + i + 1) - lgamma(n + 1) + lgamma(d + 1) + lgamma(n - d + 1))), 12) as p from e group by 1, 2, 3) select set, overlap, size, round(p, 6) as p from p",
    "genes",
)
def l14(spark, d):
    genes = standin(spark, d, "genes")
    listed = genes.where("gene_id % 9 = 0 or gene_type_id = 3 and gene_id % 2 = 0").select("gene_id")
    return J.enrichment(listed, genes.select(F.col("gene_type_id").alias("set"), "gene_id"), genes).select("set", "overlap", "size", F.round("p", 6).alias("p"))


_ANGLE = f"2 * pi() * {_R('niche-a')}"
_RADIUS = f"sqrt(-2 * ln(greatest({_R('niche-r')}, 1e-12))) * d"


@query("X8_inject_niche", f"with t as (select * from cells where slice = 1), n as (select median(d) as d from (select a.cell_id, min(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) as d from t a join t b on a.cell_id <> b.cell_id group by 1)), p as (select x, y, row_number() over (order by {_R('niche-place')}, cell_id) - 1 as k from t), m as (select count(*) as m from p), c as (select cell_id, cell_type, floor({_R('niche-target')} * m) as k from (select * from cells where slice = 2 order by {_R('niche-donor')}, cell_id limit 30), m) select cell_id || '_inj' as cell_name, cell_type, round(x + {_RADIUS} * cos({_ANGLE}), 6) as x, round(y + {_RADIUS} * sin({_ANGLE}), 6) as y, true as injected from c join p using (k), n union all {PLAIN}", "cells")
def x8(spark, d):
    cells = standin(spark, d, "cells")
    return J.inject_niche(cells.where("slice = 1"), cells.where("slice = 2"), 30).withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query("X12_shift_ot")
def x12(spark, d):
    vec, old = standin(spark, d, "vec").where("label = 3"), "label = 3 and slice = 'old'"
    return J.shift_ot(vec.where("slice = 'young'"), vec.where("slice = 'old'"), _after(spark, d).where(old))


@query("X2_resolve_symbol", "select gene_id from genes where gene_symbol = (select min(gene_symbol) from (select gene_symbol from genes group by 1 having count(*) = 1))", "genes")
def x2(spark, d):
    genes = standin(spark, d, "genes")
    one = genes.groupBy("gene_symbol").agg(F.count(F.lit(1)).alias("n")).where("n = 1").agg(F.min("gene_symbol")).first()[0]
    # Where every symbol is that of several genes there is none to resolve.
    return genes.select("gene_id").where("false") if one is None else G.resolve_symbol(genes, one)


@query("J8_condition_lookup", "with c as (select gene_id, case gene_id % 3 when 0 then gene_symbol when 1 then lower(gene_symbol) else gene_symbol || '?' end as name from genes), e as (select gene_symbol, min(gene_id) as hit from genes group by 1), l as (select lower(gene_symbol) as low, min(gene_id) as hit from genes group by 1) select c.gene_id, coalesce(e.hit, l.hit) as hit from c left join e on c.name = e.gene_symbol left join l on lower(c.name) = l.low", "genes")
def j8(spark, d):
    genes = standin(spark, d, "genes")
    third = F.col("gene_id") % 3
    name = F.when(third == 0, F.col("gene_symbol")).when(third == 1, F.lower("gene_symbol")).otherwise(F.concat("gene_symbol", F.lit("?")))
    return G.condition_lookup(genes.select("gene_id", name.alias("name")), genes, "name").select("gene_id", "hit")


def _out(spark, name):
    import uuid

    return f"{shared_folder(spark)}/spatialis-{uuid.uuid4().hex}/{name}"


def _rows(spark, d):
    expr = standin(spark, d, "expr")
    return T.token_rows(T.token_long(expr, standin(spark, d, "genes"), N.gene_nonzero_mean(expr)))


@query("S4_read_csv_maps", "select source_gene, target_gene, ord from homology", "homology")
def s4(spark, d):
    path = _out(spark, "homology")
    standin(spark, d, "homology").write.csv(path, header=True)
    return tables.read_csv_map(spark, path, "source_gene string, target_gene string, ord long")


@query("S5_write_tokens", f"with {RANKED} select cell_id, list(gene_id + 20 order by pos) as \"X\", list(homo_connect_id + 1 order by pos) as \"X_connect_comp\", list(gene_type_id + 1 order by pos) as \"X_rna_type\", list(0 order by pos) as \"X_deviation_bin\", list(round(value, 6) order by pos) as \"X_exp\" from tok group by cell_id", "expr", "genes")
def s5(spark, d):
    path = _out(spark, "tokens")
    tables.write_tokens(_rows(spark, d), path)
    return tables.read_tokens(spark, path).withColumn("X_exp", F.transform("X_exp", lambda v: F.round(v, 6)))


@query("S6_read_tokens", f"with {RANKED} select cell_id, (cell_id % 3)::int as slice, count(*)::int as n from tok group by cell_id", "expr", "genes")
def s6(spark, d):
    path = _out(spark, "tokens")
    tables.write_tokens(_rows(spark, d).withColumn("slice", F.col("cell_id") % 3), path)
    return tables.read_tokens(spark, path).select("cell_id", "slice", F.size("X").alias("n"))


@query("S8_read_many", "select cell_id, slice from cells", "cells")
def s8(spark, d):
    paths = []
    for i in range(2):
        paths.append(_out(spark, f"part{i}"))
        standin(spark, d, "cells").where(F.col("cell_id") % 2 == i).select("cell_id", "slice").write.parquet(paths[-1])
    return tables.read_many(spark, *paths).select("cell_id", "slice")


@query("S9_read_vec", "select vec_id, label, round(embedding[1]::double, 6) + 0.0 as first from vec", "vec")
def s9(spark, d):
    path = _out(spark, "vec")
    tables.write_vec(standin(spark, d, "vec"), path)
    return spark.read.parquet(path).select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("S11_write_report", "select cell_type, count(*) as n from cells group by 1", "cells")
def s11(spark, d):
    path = _out(spark, "report")
    tables.write_report(standin(spark, d, "cells").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.csv(path, header=True, schema="cell_type string, n long")


@query("E13_eval_dispatch")
def e13(spark, d):
    vec = standin(spark, d, "vec")
    ref, asked = vec.where("role = 'ref'"), vec.where("role = 'query'")
    said = nearest_centroid(centroids(ref, ["label"]), asked).join(asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth")), "query_id")
    return J.downstream_eval("annotation", df=said)


@query("S7_write_model_input", MODEL_INPUT_SQL, "expr", "genes")
def s7(spark, d):
    path = _out(spark, "model_input")
    tables.write_model_input(k3(spark, d), path, 100)
    return spark.read.parquet(path)


_PREFIXED = "aux as (select cell_id, row_number() over (order by cell_id) - 1 as place, dense_rank() over (order by slice) % 5 + 15 as density_token, 4 as specie_token, 7 as assay_token, slice as cell_label from cells where cell_id in (select cell_id from tok)), tall as (select cell_id, pos + 3 as pos, gene_id + 20 as token, homo_connect_id + 1 as h, gene_type_id + 1 as t, gene_id % 6 as b, value as v from tok where pos < 30 union all select cell_id, unnest(range(3))::int, unnest([specie_token, assay_token, density_token])::bigint, 0, 0, 0, 0.0 from aux)"
_M3 = lambda k: f"(('0x' || substr(md5(concat_ws('|', 'mask-{k}', cell_id::varchar, pos::varchar)), 1, 8))::bigint / 4294967296.0)"
MODEL_ROWS_SQL = f"""with {RANKED}, {_PREFIXED},
m as (select *, case when not hit then token when {_M3('random')} < 0.1 then other when {_M3('same')} < 0.1 then token else 0 end as masked from (select *, token > 20 and {_M3('hit')} < 0.15 as hit, (floor({_M3('which')} * 2999) + 21)::bigint as other from tall))
select m.cell_id, m.cell_id::varchar as cell_raw_index, list(masked::bigint order by pos) as masked_indices, list((case when hit then 0 else 1 end)::int order by pos) as mask, list(token::bigint order by pos) as real_indices, list(h order by pos) as connect_comp, list(t order by pos) as rna_type, list(b::int order by pos) as neighbor_gene_distribution, list(round(v, 6) order by pos) as exp, list(masked = 1 order by pos) as attention_mask, any_value(cell_label)::bigint as cell_label, any_value(place // 64)::bigint as batch_id from m join aux on m.cell_id = aux.cell_id group by m.cell_id"""


def _model_rows(spark, d):
    """Rows with bins of their own, codes and density tokens, cut to 30 tokens, in batches of 64 cells."""
    expr, genes, cells = _all(spark, d, "expr", "genes", "cells")
    expr = staged(expr, "expr")  # read for tokens, means and bins
    bins = expr.select("cell_id", "gene_id", (F.col("gene_id") % 6).cast("int").alias("deviation_bin"))
    rows = T.token_rows(T.token_long(expr, genes, N.gene_nonzero_mean(expr), bins))
    place = cells.select("slice").distinct().withColumn("density_token", (F.row_number().over(Window.orderBy("slice")) % 5 + 15).cast("long"))
    obs = cells.join(F.broadcast(place), "slice").select("cell_id", "density_token", F.lit(4).alias("specie_token"), F.lit(7).alias("assay_token"), F.col("slice").alias("cell_label"))
    return T.model_rows(rows.join(obs, "cell_id"), 3000, 64, 30).withColumn("exp", F.transform("exp", lambda v: F.round(v, 6)))


@query("K3_model_rows", MODEL_ROWS_SQL, "expr", "genes", "cells")
def k3rows(spark, d):
    return _model_rows(spark, d)


@query("S7_model_batches", f"with r as ({MODEL_ROWS_SQL}) select batch_id, count(*) as n, sum(len(real_indices))::bigint as tokens from r group by 1", "expr", "genes", "cells")
def s7batches(spark, d):
    path = _out(spark, "model_rows")
    manifest = tables.write_model_input(_model_rows(spark, d), path, 64)
    tokens = spark.read.parquet(path).groupBy("batch_id").agg(F.sum(F.size("real_indices")).alias("tokens"))
    return manifest.groupBy("batch_id").agg(F.sum("n").alias("n")).join(tokens, "batch_id")


@query("S10_read_json_meta", "select slice as batch_id, min(n_regionkey)::bigint as dataset_id, count(*) as batch_size, count(*) * 2 as n_genes from (select slice, substr(region, 2)::int as n_regionkey from cells) group by slice", "cells")
def s10(spark, d):
    path = _out(spark, "meta")
    cells = standin(spark, d, "cells").withColumn("dataset_id", F.substring("region", 2, 9).cast("long"))
    own = cells.groupBy(F.col("slice").alias("batch_id")).agg(F.min("dataset_id").alias("dataset_id"), F.first("platform").alias("platform"), F.count(F.lit(1)).alias("batch_size"))
    # One row for each batch: metadata, as few as there are slices.
    lists = own.select(F.col("batch_id").alias("id"), F.transform(F.sequence(F.lit(1), F.col("batch_size") * 2), lambda i: F.concat(F.lit("g"), i.cast("string"))).alias("gene_list"))
    whole = own.agg(F.collect_list(F.struct("batch_id", "dataset_id", "platform", "batch_size")).alias("batches")).crossJoin(lists.agg(F.collect_list(F.struct("id", "gene_list")).alias("datasets")))
    whole.write.json(path)
    batches, genes = tables.read_json_meta(spark, path)
    n = genes.groupBy(F.col("dataset_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("n_genes"))
    return batches.join(n, "batch_id").select("batch_id", "dataset_id", "batch_size", "n_genes")
