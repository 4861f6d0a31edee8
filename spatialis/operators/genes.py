"""Gene identifiers, homologs and set operations on genes, cells and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialis.operators.qc import require


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key, by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unique_names(df: DataFrame, name: str, order: list[Column | str]) -> DataFrame:
    """Names made unique: -1, -2, ... from the second on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    return df.withColumn("_n", n).withColumn(name, F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(name, F.lit("-"), F.col("_n").cast("string")))).drop("_n")


def symbol_map(genes: DataFrame) -> DataFrame:
    """gene_symbol to ensembl_id; of a repeated symbol the last gene counts."""
    return dedupe_first(genes.select("gene_symbol", "ensembl_id", "gene_id"), ["gene_symbol"], [F.desc("gene_id")]).select("gene_symbol", "ensembl_id")


def symbol_to_ensembl(named: DataFrame, *sources: DataFrame) -> DataFrame:
    """Rows with gene_symbol, with their ensembl_id by the first of the sources (gene_symbol, ensembl_id, one row for
    each symbol) that knows the symbol; what none knows goes."""
    own, ids = named.drop("ensembl_id"), []
    for i, symbols in enumerate(sources):
        ids.append(f"_id{i}")
        own = own.join(symbols.select("gene_symbol", F.col("ensembl_id").alias(ids[-1])), "gene_symbol", "left")
    return own.withColumn("ensembl_id", F.coalesce(*ids)).where("ensembl_id is not null").drop(*ids)


def resolve_symbol(genes: DataFrame, symbol: str) -> DataFrame:
    """The one gene of a symbol; none or several is an error."""
    hits = genes.where(F.col("gene_symbol") == symbol).agg(F.count(F.lit(1)).alias("n"), F.min("gene_id").alias("gene_id"))
    return require(hits, F.col("n") != 1, f"the symbol {symbol} isn't that of one gene").select("gene_id")


def condition_lookup(conditions: DataFrame, genes: DataFrame, name: str) -> DataFrame:
    """`hit`: the gene of a condition's name as it is written, else in lower case, else null; of a repeated
    symbol the smallest gene."""
    exact = genes.groupBy(F.col("gene_symbol").alias(name)).agg(F.min("gene_id").alias("_exact"))
    low = genes.groupBy(F.lower("gene_symbol").alias("_name")).agg(F.min("gene_id").alias("_low"))
    found = conditions.join(exact, name, "left").withColumn("_name", F.lower(name)).join(low, "_name", "left")
    return found.withColumn("hit", F.coalesce("_exact", "_low")).drop("_exact", "_low", "_name")


def homolog_pairs(homology: DataFrame) -> DataFrame:
    """(source_gene, target_gene), one to one: of a repeated source the first, then of a repeated target."""
    first = dedupe_first(homology.where("source_gene is not null and target_gene is not null"), ["source_gene"], ["ord"])
    return dedupe_first(first, ["target_gene"], ["ord"]).select("source_gene", "target_gene")


def map_homologs(expr: DataFrame, genes: DataFrame, homology: DataFrame) -> DataFrame:
    """(cell_id, target_gene, value): values under the target species' genes; what falls on one is summed."""
    named = expr.join(genes.select("gene_id", F.col("gene_symbol").alias("source_gene")), "gene_id")
    return sum_duplicate_genes(named.join(homolog_pairs(homology), "source_gene"), "target_gene")


def sum_duplicate_genes(expr: DataFrame, gene: str) -> DataFrame:
    return expr.groupBy("cell_id", gene).agg(F.sum("value").alias("value"))


def orthologs_one2one(orthologs: DataFrame, human: DataFrame) -> DataFrame:
    """One-to-one orthologs with a human gene, and its symbol."""
    own = orthologs.where("type = 'ortholog_one2one' and human_id is not null")
    return own.join(human.select(F.col("ensembl_id").alias("human_id"), F.col("gene_symbol").alias("human_symbol")), "human_id", "left")


def concat_outer(parts: dict[str, DataFrame]) -> DataFrame:
    """Datasets one after another, tagged with their names; missing values stay absent."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to stack")
    return out


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def all_categories(df: DataFrame, *columns: str) -> DataFrame:
    out = df.select(F.col(columns[0]).alias("category"))
    for c in columns[1:]:
        out = out.union(df.select(F.col(c)))
    return out.distinct()


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """(label, code) for the distinct labels in order; there are few of them, so one window over them is
    no bottleneck."""
    return df.select(label).where(F.col(label).isNotNull()).distinct().withColumn("code", F.row_number().over(Window.orderBy(label)) - 1)


def label_encode(df: DataFrame, label: str, codes: DataFrame) -> DataFrame:
    """`df` with the label's code; a label without one is an error."""
    joined = df.join(F.broadcast(codes), label, "left")
    return require(joined, F.col("code").isNull(), "a label has no code")


def gene_mask(batch_genes: DataFrame, genes: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch_id, gene_id, available): all genes of a batch without a list are available."""
    listed = batch_genes.select("batch_id").distinct().withColumn("listed", F.lit(True))
    own = batch_genes.select("batch_id", "gene_id").distinct().withColumn("there", F.lit(True))
    pairs = batches.select("batch_id").distinct().crossJoin(genes.select("gene_id"))
    return pairs.join(listed, "batch_id", "left").join(own, ["batch_id", "gene_id"], "left").select("batch_id", "gene_id", (F.col("listed").isNull() | F.col("there").isNotNull()).alias("available"))
