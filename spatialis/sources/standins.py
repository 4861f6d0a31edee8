"""Stand-ins for the library's logical tables over the given tables, as SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CELLS = """select c_custkey as cell_id, cast(c_nationkey as bigint) as slice, concat('R', cast(n_regionkey as varchar(2))) as region, c_mktsegment as cell_type, cast((c_custkey*7919) % 1009 as double) as x, cast((c_custkey*104729) % 1013 as double) as y, case when c_custkey % 4 = 0 then 'MERFISH' when c_custkey % 4 = 1 then 'XENIUM' when c_custkey % 4 = 2 then 'STARMAP' else 'SLIDESEQV2' end as platform from customer join nation on c_nationkey = n_nationkey"""
EXPR = """select o_custkey as cell_id, l_partkey as gene_id, cast(sum(l_quantity) as double) as value from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_partkey"""
GENES = """select p_partkey as gene_id, concat('ENSG', lpad(cast(p_partkey as varchar(11)), 11, '0')) as ensembl_id, concat(p_brand, '_', cast(p_partkey % 11 as varchar(5))) as gene_symbol, p_partkey % 97 as homo_connect_id, cast(p_size % 33 as bigint) as gene_type_id from part"""
HOMOLOGY = """select concat(p_brand, '_', cast(p_partkey % 11 as varchar(5))) as source_gene, case when p_partkey % 7 = 0 then null else concat('T', cast(p_partkey % 150 as varchar(5))) end as target_gene, p_partkey as ord from part"""
MARKERS = """select c_mktsegment as class, l_partkey as gene_id, cast(avg(l_quantity) as double) / 10 as weight from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey where l_partkey % 10 = 0 group by c_mktsegment, l_partkey"""
VEC = """select vec_id, label, case when vec_id % 5 = 0 then 'query' else 'ref' end as role, case when vec_id % 2 = 0 then 'young' else 'old' end as slice, embedding from embeddings"""
ALL = {"cells": CELLS, "expr": EXPR, "genes": GENES, "homology": HOMOLOGY, "markers": MARKERS, "vec": VEC}
_TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "embeddings")


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table by its name."""
    words = ALL[name].replace(",", " ").split()
    used = [t for t in _TABLES if t in words]
    sql = ALL[name]
    for t in used:
        for lead in ("from", "join"):
            sql = sql.replace(f"{lead} {t}", f"{lead} {{{t}}}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_standins(sql: str, *names: str) -> str:
    """SQL over logical tables, as SQL over the given ones."""
    parts = [f"{n} as ({ALL[n]})" for n in names]
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ", ".join(parts) + ", " + body[5:]
    return "with " + ", ".join(parts) + " " + body
