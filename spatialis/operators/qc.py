"""Filters and column clean-up on cells, genes and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatialis.functions.scalars import all_equal

#: Tokens of species and technologies.
SPECIES = {"human": 3, "mouse": 4, "macaque": 5, "marmoset": 6}
TECHNOLOGY = {"merfish": 7, "xenium": 8, "starmap": 9, "slideseqv2": 10, "stereo": 11, "snrna": 12}


def require(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """`df`, whose evaluation fails on a row where `bad` holds."""
    return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def filter_cells_min_genes(expr: DataFrame, n: int) -> DataFrame:
    """Values of cells with at least n genes above zero."""
    keep = expr.where("value > 0").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n).select("cell_id")
    return expr.join(keep, "cell_id", "left_semi")


def filter_genes_min_cells(expr: DataFrame, n: int) -> DataFrame:
    """Values of genes above zero in at least n of the cells given."""
    keep = expr.where("value > 0").groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n).select("gene_id")
    return expr.join(keep, "gene_id", "left_semi")


def filter_cells_min_counts(expr: DataFrame, least: float = 5) -> DataFrame:
    keep = expr.groupBy("cell_id").agg(F.sum("value").alias("total")).where(F.col("total") >= least).select("cell_id")
    return expr.join(keep, "cell_id", "left_semi")


def clean_batches(cells: DataFrame, expr: DataFrame, batch: str, least_counts: float = 5, least_cells: int = 500) -> DataFrame:
    """Cells with enough counts, of batches that then hold enough cells."""
    good = cells.join(filter_cells_min_counts(expr, least_counts).select("cell_id"), "cell_id", "left_semi")
    keep = good.groupBy(batch).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_cells).select(batch)
    return good.join(keep, batch, "left_semi")


def filter_finite_coords(cells: DataFrame) -> DataFrame:
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return cells.where(fine("x") & fine("y"))


def check_ensembl(genes: DataFrame, column: str = "ensembl_id") -> DataFrame:
    return require(genes, ~F.coalesce(F.startswith(column, F.lit("ENS")), F.lit(False)), "a gene id isn't an Ensembl id")


def filter_vocab(expr: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Values of genes in the vocabulary; that none matches is an error."""
    kept = expr.join(vocabulary.select("gene_id"), "gene_id", "left_semi")
    if kept.isEmpty():
        raise ValueError("no gene is in the vocabulary")
    return kept


#: The covariates a model takes.
COVARIATES = ("batch", "dataset", "platform")


def check_covariates(covariates: list[str]) -> list[str]:
    """The covariates, none of which a model doesn't take."""
    unknown = [c for c in covariates if c not in COVARIATES]
    if unknown:
        raise ValueError(f"unknown covariates {', '.join(unknown)}")
    return covariates


def where_all(df: DataFrame, where: dict[str, object]) -> DataFrame:
    return df.where(all_equal(where))


def drop_unassigned(df: DataFrame, column: str = "pred") -> DataFrame:
    return df.where(F.col(column) != "unassigned")


def drop_other_types(cells: DataFrame) -> DataFrame:
    return cells.where(~F.lower("cell_type").isin("other", "others"))


def drop_zero_mean_genes(gene_mean: DataFrame) -> DataFrame:
    return gene_mean.where("mean <> 0")


def marker_cutoff(markers: DataFrame, cutoff: float) -> DataFrame:
    return markers.where(F.col("weight") > cutoff)


def select_obs(cells: DataFrame, keep: list[str]) -> DataFrame:
    """Those of the columns that are there."""
    return cells.select(*[c for c in keep if c in cells.columns])


def default_obs(cells: DataFrame, columns: tuple[str, ...] = ("slice", "region", "brain_region")) -> DataFrame:
    return cells.withColumns({c: F.lit("unknown") for c in columns if c not in cells.columns})


def xy_from_spatial(cells: DataFrame, assay: Column) -> DataFrame:
    """x and y from the vector `spatial`, else rx and ry, else x and y; single nuclei lie at 0, 0."""
    pick = lambda i, *names: F.coalesce(*([F.try_element_at("spatial", F.lit(i))] if "spatial" in cells.columns else []), *[F.col(n) for n in names if n in cells.columns])
    flat = F.lower(assay) == "snrna"
    return cells.withColumns({"x": F.when(flat, 0.0).otherwise(pick(1, "rx", "x")), "y": F.when(flat, 0.0).otherwise(pick(2, "ry", "y"))})


def encode_codes(cells: DataFrame, species: Column, assay: Column) -> DataFrame:
    """Tokens of species and technology, by lower-cased name; unknown names have none."""
    lookup = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return cells.withColumns({"specie_token": F.try_element_at(lookup(SPECIES), F.lower(species)), "assay_token": F.try_element_at(lookup(TECHNOLOGY), F.lower(assay))})


def region_source(cells: DataFrame, absolute: bool = False) -> DataFrame:
    """The neighbourhood key: the slice, with the label, or the slice twice; two columns, not one text."""
    return cells.withColumns({"brain_region": F.col("slice").cast("string"), "brain_region_main": F.col("slice").cast("string") if absolute else F.col("cell_type")})


def widen_types(df: DataFrame) -> DataFrame:
    """Integers as long, floats as double."""
    to = {"tinyint": "long", "smallint": "long", "int": "long", "float": "double"}
    return df.select(*[F.col(c).cast(to.get(t, t)).alias(c) for c, t in df.dtypes])


def mark_injected(cells: DataFrame, origin: Column, cell_type: Column) -> DataFrame:
    return cells.withColumns({"injected": F.lit(True), "injected_from_slice": origin, "injected_celltype": cell_type})
