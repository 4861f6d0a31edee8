"""Queries on gene identifiers, homologs, sets and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialis.operators import genes as G
from spatialis.plans.registry import query
from spatialis.sources.standins import standin

PAIRS = "pairs as (select source_gene, target_gene from (select *, row_number() over (partition by target_gene order by ord) as b from (select *, row_number() over (partition by source_gene order by ord) as a from homology where source_gene is not null and target_gene is not null) where a = 1) where b = 1)"


@query("J2_symbol_to_ensembl", "select g.gene_id, s.ensembl_id from genes g join (select gene_symbol, ensembl_id from genes qualify row_number() over (partition by gene_symbol order by gene_id desc) = 1) s using (gene_symbol)", "genes")
def j2(spark, d):
    genes = standin(spark, d, "genes")
    return G.symbol_to_ensembl(genes.select("gene_id", "gene_symbol"), G.symbol_map(genes)).select("gene_id", "ensembl_id")


@query(
    "J2_symbol_fallback",
    "with m as (select gene_symbol, ensembl_id, gene_id % 3 as source from genes qualify row_number() over (partition by gene_symbol, gene_id % 3 order by gene_id desc) = 1) select g.gene_id, coalesce(a.ensembl_id, b.ensembl_id, c.ensembl_id) as ensembl_id from genes g left join (select * from m where source = 0) a using (gene_symbol) left join (select * from m where source = 1) b using (gene_symbol) left join (select * from m where source = 2 and substr(gene_symbol, -1) <> '7') c using (gene_symbol) where coalesce(a.ensembl_id, b.ensembl_id, c.ensembl_id) is not null",
    "genes",
)
def j2fallback(spark, d):
    """Three sources, each knowing a part of the symbols."""
    genes = standin(spark, d, "genes")
    sources = [G.symbol_map(genes.where(F.col("gene_id") % 3 == i)) for i in range(3)]
    sources[2] = sources[2].where("substr(gene_symbol, -1) <> '7'")
    return G.symbol_to_ensembl(genes.select("gene_id", "gene_symbol"), *sources).select("gene_id", "ensembl_id")


@query("J3_map_homologs", f"with {PAIRS} select e.cell_id, p.target_gene, sum(e.value) as value from expr e join genes g using (gene_id) join pairs p on g.gene_symbol = p.source_gene group by 1, 2", "expr", "genes", "homology")
def j3(spark, d):
    return G.map_homologs(*[standin(spark, d, n) for n in ("expr", "genes", "homology")])


ORTHO = "ortho as (select gene_id as source_id, case when gene_id % 7 = 0 then null else concat('ENSG', lpad(cast((gene_id * 3) % 150 as varchar), 11, '0')) end as human_id, case when gene_id % 4 = 0 then 'ortholog_one2many' else 'ortholog_one2one' end as type from genes)"


@query("J4_orthologs_one2one", f"with {ORTHO} select o.source_id, o.human_id, g.gene_symbol as human_symbol from ortho o left join genes g on o.human_id = g.ensembl_id where o.type = 'ortholog_one2one' and o.human_id is not null", "genes")
def j4(spark, d):
    genes = standin(spark, d, "genes")
    human = F.concat(F.lit("ENSG"), F.lpad(((F.col("gene_id") * 3) % 150).cast("string"), 11, "0"))
    ortho = genes.select(F.col("gene_id").alias("source_id"), F.when(F.col("gene_id") % 7 != 0, human).alias("human_id"), F.when(F.col("gene_id") % 4 == 0, "ortholog_one2many").otherwise("ortholog_one2one").alias("type"))
    return G.orthologs_one2one(ortho, genes).select("source_id", "human_id", "human_symbol")


@query("W4_dedupe_first", "select source_gene, ord from homology qualify row_number() over (partition by source_gene order by ord) = 1", "homology")
def w4(spark, d):
    return G.dedupe_first(standin(spark, d, "homology"), ["source_gene"], ["ord"]).select("source_gene", "ord")


@query("W5_unique_names", "select gene_id, case when n = 0 then gene_symbol else gene_symbol || '-' || n end as gene_symbol from (select *, row_number() over (partition by gene_symbol order by gene_id) - 1 as n from genes)", "genes")
def w5(spark, d):
    return G.unique_names(standin(spark, d, "genes"), "gene_symbol", ["gene_id"]).select("gene_id", "gene_symbol")


@query("W6_label_encode", "select cell_id, (dense_rank() over (order by cell_type) - 1)::int as code from cells", "cells")
def w6(spark, d):
    cells = standin(spark, d, "cells")
    return G.label_encode(cells, "cell_type", G.label_codes(cells, "cell_type")).select("cell_id", "code")


@query("A13_sum_duplicate_genes", "select cell_id, gene_symbol, sum(value) as value from expr join genes using (gene_id) group by 1, 2", "expr", "genes")
def a13(spark, d):
    named = standin(spark, d, "expr").join(standin(spark, d, "genes").select("gene_id", "gene_symbol"), "gene_id")
    return G.sum_duplicate_genes(named, "gene_symbol")


@query("U1_concat_outer", "select cell_id, cell_type, null::double as x, 'a' as source from cells where slice < 3 union all select cell_id, null, x, 'b' from cells where slice = 3", "cells")
def u1(spark, d):
    cells = standin(spark, d, "cells")
    return G.concat_outer({"a": cells.where("slice < 3").select("cell_id", "cell_type"), "b": cells.where("slice = 3").select("cell_id", "x")})


@query("U2_intersect_keys", "select gene_id from expr where cell_id % 2 = 0 intersect select gene_id from expr where cell_id % 3 = 0", "expr")
def u2(spark, d):
    expr = standin(spark, d, "expr")
    return G.intersect_keys(expr.where("cell_id % 2 = 0"), expr.where("cell_id % 3 = 0"), "gene_id")


@query("U3_missing_keys", "select distinct gene_id from markers where gene_id not in (select gene_id from expr join cells using (cell_id) where slice = 3)", "markers", "expr", "cells")
def u3(spark, d):
    one = standin(spark, d, "cells").where("slice = 3").select("cell_id")
    return G.missing_keys(standin(spark, d, "markers"), standin(spark, d, "expr").join(one, "cell_id", "left_semi"), "gene_id")


@query("U4_all_categories", "select cell_type as category from cells union select region from cells", "cells")
def u4(spark, d):
    return G.all_categories(standin(spark, d, "cells"), "cell_type", "region")


@query("J11_semi_anti", "select * from expr where gene_id in (select gene_id from markers) and cell_id not in (select cell_id from cells where slice = 2)", "expr", "markers", "cells")
def j11(spark, d):
    expr = standin(spark, d, "expr").join(standin(spark, d, "markers").select("gene_id"), "gene_id", "left_semi")
    return expr.join(standin(spark, d, "cells").where("slice = 2"), "cell_id", "left_anti")


@query("J12_gene_mask", "with b as (select distinct slice as batch_id from cells), l as (select distinct slice as batch_id, gene_id from cells join expr using (cell_id) where slice % 2 = 0) select b.batch_id, g.gene_id, (b.batch_id not in (select batch_id from l) or l.gene_id is not null) as available from b cross join (select gene_id from genes) g left join l on l.batch_id = b.batch_id and l.gene_id = g.gene_id", "cells", "expr", "genes")
def j12(spark, d):
    cells = standin(spark, d, "cells").select("cell_id", F.col("slice").alias("batch_id"))
    listed = cells.where("batch_id % 2 = 0").join(standin(spark, d, "expr"), "cell_id").select("batch_id", "gene_id")
    return G.gene_mask(listed, standin(spark, d, "genes"), cells)


@query("J16_batch_dataset", "select distinct c.slice as batch_id, c.region as dataset_id, e.gene_id from cells c join expr e using (cell_id)", "cells", "expr")
def j16(spark, d):
    batches = standin(spark, d, "cells").select("cell_id", F.col("slice").alias("batch_id"), F.col("region").alias("dataset_id"))
    return batches.join(standin(spark, d, "expr"), "cell_id").select("batch_id", "dataset_id", "gene_id").distinct()
