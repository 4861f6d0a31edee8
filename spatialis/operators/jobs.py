"""Whole jobs composed of operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialis.functions.scalars import cosine, distance2, hashed
from spatialis.operators import genes as G
from spatialis.operators import metrics as E
from spatialis.operators import normalize as N
from spatialis.operators import perturb as X
from spatialis.operators import qc as Q
from spatialis.operators import spatial as S
from spatialis.operators import tokens as T
from spatialis.operators.quantiles import quantiles
from spatialis.operators.running import running_sums
from spatialis.operators.transfer import centroids, scale_pca
from spatialis.sources.staging import staged


def tokenize_dataset(
    cells: DataFrame,
    expr: DataFrame,
    genes: DataFrame,
    species: str = "mouse",
    assay: str = "merfish",
    *,
    split: str | None = None,
    label: str | None = None,
    codes: DataFrame | None = None,
    means: DataFrame | None = None,
    k: int = 50,
    min_genes: int = 3,
    min_cells: int = 3,
    n_hvg: int | None = None,
    impute: bool = False,
    absolute: bool = False,
    niche: bool = True,
    density: bool = True,
    max_length: int = T.MAX_LENGTH,
    chunk: int = 10_000,
) -> DataFrame:
    """Token rows of a dataset with what is known of their cells: imputation (stereo alone), quality control, the
    most variable genes, one split, label codes, species and assay tokens, density tokens, deviation bins among
    the k nearest of a region key, ranks, and `chunk`, a number for each about `chunk` cells.

    Single nuclei have no imputation, bins or densities. Codes (label, code) are made in the order of the labels
    where none are given; without a label they are 0. `absolute` compares cells of a slice, else of a slice and
    label; `means` (gene_id, mean) are those of the dataset where none are given. Coordinates are cell_x and
    cell_y, as x and X are one name to Spark."""
    assay = assay.lower()
    if assay not in Q.TECHNOLOGY or species.lower() not in Q.SPECIES:
        raise ValueError(f"unknown assay {assay} or species {species}")
    nuclei = assay == "snrna"
    placed = Q.xy_from_spatial(Q.default_obs(cells), F.lit(assay))
    placed = placed if nuclei else Q.filter_finite_coords(placed)
    if impute and assay == "stereo":
        expr = impute_dataset(placed, expr, 50)
    good = Q.filter_genes_min_cells(Q.filter_cells_min_genes(expr, min_genes), min_cells)
    if n_hvg:
        good = staged(good, "good")
        good = good.join(N.highly_variable(N.log_normalize(good), n_hvg), "gene_id", "left_semi")
    placed = placed if split is None else placed.where(F.col("split") == split)
    # Tables of cells are merged, not broadcast: their files are far smaller than their rows in memory.
    good = staged(good.join(placed.select("cell_id").hint("merge"), "cell_id", "left_semi"), "good")
    placed = placed.join(good.select("cell_id").distinct().hint("merge"), "cell_id", "left_semi")
    if label is None:
        placed = placed.withColumn("cell_label", F.lit(0).cast("bigint"))
    else:
        # As many labels as there are types of cells.
        own = placed.select(label).distinct().withColumn("code", F.row_number().over(Window.orderBy(label)) - 1) if codes is None else codes
        placed = G.label_encode(placed, label, own).withColumn("cell_label", F.col("code").cast("bigint"))
    placed = Q.encode_codes(placed, F.lit(species), F.lit(assay)).withColumn("cell_type", F.col("cell_label").cast("string"))
    placed = staged(Q.region_source(placed, absolute), "cells")
    kept = ["cell_id", "slice", "region", "brain_region", "brain_region_main", "cell_x", "cell_y", "cell_label", "specie_token", "assay_token"]
    numbered, _ = X.numbered(placed.withColumnsRenamed({"x": "cell_x", "y": "cell_y"}).select(*kept), "chunk")
    obs = numbered.withColumn("chunk", F.floor(F.col("k") / chunk)).drop("k")
    if density and not nuclei:
        um = S.to_microns(placed.withColumn("platform", F.lit(assay.upper())), ["slice"]).select("cell_id", "slice", F.col("x_um").alias("x"), F.col("y_um").alias("y"))
        level = S.density_token(um, S.RADIUS.get(assay.upper(), 200)).select("cell_id", (F.col("density_token") + T.DENSITY).alias("density_token"))
        obs = obs.join(level.hint("merge"), "cell_id")
    bins = None
    if niche and not nuclei:
        edges = S.knn_in_group(placed, k, ["brain_region", "brain_region_main"], part=True)
        bins = S.held_bins(edges, N.normalize_total(good), absolute, 1e-4 if absolute else None)
    else:
        obs = obs.withColumn("density_token", F.lit(0))
    tokens = T.token_long(good, Q.check_ensembl(genes), N.gene_nonzero_mean(good) if means is None else means, bins, max_length)
    return T.token_rows(tokens).join(obs.hint("merge"), "cell_id")


def prepare_dataset(cells: DataFrame, expr: DataFrame, genes: DataFrame, homology: DataFrame | None, n_hvg: int, smooth_k: int | None = 25, symbols: DataFrame | None = None, force: list[str] | None = None) -> DataFrame:
    """(cell_id, gene_id, value) for label transfer, gene_id being the gene's name: finite coordinates, smoothing
    over smooth_k others (none without it), quality control, the target species' genes (none to map without
    homology), those with an id in `symbols` (gene_symbol, ensembl_id), of a repeated name the first, and of
    these the most variable and those named by `force`."""
    placed = Q.filter_finite_coords(cells)
    values = expr.join(placed.select("cell_id").hint("merge"), "cell_id", "left_semi")
    least = F.least(F.lit(200), F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * 0.01)))
    n = int(genes.agg(least.alias("n")).first()["n"])

    def names(good: DataFrame) -> DataFrame:
        if homology is None:
            first = G.dedupe_first(genes.select("gene_id", "gene_symbol").join(good.select("gene_id").distinct(), "gene_id", "left_semi"), ["gene_symbol"], ["gene_id"])
            named = good.join(first, "gene_id").select("cell_id", F.col("gene_symbol").alias("gene_id"), "value")
        else:
            named = G.map_homologs(good, genes, homology).withColumnRenamed("target_gene", "gene_id")
        if symbols is not None:
            named = named.join(symbols.select(F.col("gene_symbol").alias("gene_id")).distinct(), "gene_id", "left_semi")
        return named

    if smooth_k is None:
        named = staged(names(staged(Q.filter_genes_min_cells(Q.filter_cells_min_genes(staged(values, "values"), n), 3), "good")), "named")
    else:
        edges = S.gaussian_weights(staged(S.knn_in_group(placed, smooth_k + 1, ["slice"], part=True).select("_part", "cell_id", "nbr_id", "dist2"), "near"), "median")
        named = staged(S.filtered_smooth(edges, values, n, 3, names), "named")
    forced = None if force is None else named.select("gene_id").distinct().where(F.col("gene_id").isin(force))
    # As many rows as are asked for.
    return named.join(F.broadcast(N.highly_variable(N.log_normalize(named, known=None if smooth_k is None else "total"), n_hvg, forced)), "gene_id", "left_semi").select("cell_id", "gene_id", "value")


def expression_components(expr: DataFrame, genes: DataFrame, n: int) -> DataFrame:
    """(vec_id, pc): n components of cells over the genes, a few thousand at most; absent values are zeros."""
    index = staged(genes.select("gene_id", (F.row_number().over(Window.orderBy("gene_id")) - 1).alias("i")), "index")
    width = index.count()
    lists = expr.join(F.broadcast(index), "gene_id").groupBy("cell_id").agg(F.collect_list("i").alias("i"), F.collect_list("value").alias("v"))

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = np.zeros((len(b), width))
            for row, i, v in zip(rows, b["i"], b["v"]):
                row[i] = v
            yield pd.DataFrame({"vec_id": b["cell_id"], "embedding": list(rows)})

    return scale_pca(lists.mapInPandas(dense, "vec_id long, embedding array<double>"), min(n, width))


def impute_dataset(cells: DataFrame, expr: DataFrame, k: int = 20, spatial_weight: float = 0.5, min_genes: int = 3, min_cells: int = 3, n_hvg: int = 2000, n_pcs: int = 50) -> DataFrame:
    """(cell_id, gene_id, value): quality control, components of the most variable normalised genes, and values
    imputed by them (spatial_impute). Cells that quality control leaves without values drop out."""
    good = staged(Q.filter_genes_min_cells(Q.filter_cells_min_genes(expr, min_genes), min_cells), "good")
    normal = N.normalize_total(good)
    components = staged(expression_components(normal, N.highly_variable(normal, n_hvg), n_pcs), "components")
    return spatial_impute(cells.join(components.select(F.col("vec_id").alias("cell_id")), "cell_id", "left_semi"), good, components, k, spatial_weight)


def spatial_impute(cells: DataFrame, expr: DataFrame, components: DataFrame, k: int = 20, spatial_weight: float = 0.5) -> DataFrame:
    """Weighted mean of neighbours' raw values, 0 at least. Weights blend cosine of components and a Gaussian
    of distance (twice the squared mean distance), each over its greatest, and sum to one."""
    edges = S.knn_in_group(Q.filter_finite_coords(cells), k, ["slice"])
    vec = components.select(F.col("vec_id").alias("cell_id"), "pc")
    pairs = edges.join(vec, "cell_id").join(vec.select(F.col("cell_id").alias("nbr_id"), F.col("pc").alias("nbr_pc")), "nbr_id")
    w = Window.partitionBy("cell_id")
    mean = F.avg(F.sqrt("dist2")).over(w)
    weighed = pairs.withColumns({"a": F.coalesce(cosine("pc", "nbr_pc"), F.lit(0.0)), "b": F.exp(-F.col("dist2") / F.when(mean == 0, 1.0).otherwise(2 * mean * mean))})
    scaled = lambda c: F.when(F.max(c).over(w) > 0, F.col(c) / F.max(c).over(w)).otherwise(F.col(c))
    mixed = weighed.withColumn("w", (1 - spatial_weight) * scaled("a") + spatial_weight * scaled("b"))
    total = F.sum("w").over(w)
    shares = mixed.select("cell_id", "nbr_id", (F.col("w") / F.when(total == 0, 1.0).otherwise(total)).alias("w"))
    sums = shares.join(expr.withColumnRenamed("cell_id", "nbr_id"), "nbr_id").groupBy("cell_id", "gene_id").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return sums.withColumn("value", F.greatest("value", F.lit(0.0)))


def _auroc(votes: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, auroc) of votes (by, label, v): how well v ranks the rows of a label above the others, ties at
    their mean rank."""
    counts = votes.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("k"))
    ranks = running_sums(counts, by, "v", "k").select(*by, "v", (F.col("before_k") + (F.col("k") + 1) / 2).alias("rank"))
    own = votes.join(ranks, [*by, "v"]).groupBy(*by, "label").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    n, every = F.col("n"), F.sum("n").over(Window.partitionBy(*by))
    return own.select("label", *by, ((F.col("r") - n * (n + 1) / 2) / (n * F.nullif(every - n, F.lit(0)))).alias("auroc"))


def celltype_auroc(ref: DataFrame, query: DataFrame) -> DataFrame:
    """(label, center, auroc): how well a reference centroid's vote (cosine) ranks the query rows of a label
    above the others, ties at their mean rank."""
    centers = centroids(ref, ["label"]).withColumnRenamed("label", "center")
    votes = query.select("vec_id", "label", "embedding").crossJoin(F.broadcast(centers)).select("vec_id", "label", "center", F.round(cosine("embedding", "centroid"), 9).alias("v"))
    return _auroc(votes, ["center"])


def rank_normalised(expr: DataFrame, n_genes: int) -> DataFrame:
    """(cell_id, gene_id, r): how far a value's rank within its cell over all n_genes, ties at their mean rank, lies
    above that of the cell's zeros, in units of the ranks' length after centring. Zeros aren't stored: they share the
    lowest ranks."""
    cell = Window.partitionBy("cell_id")
    own = expr.where("value > 0")
    nnz, ties = F.count(F.lit(1)).over(cell), F.count(F.lit(1)).over(Window.partitionBy("cell_id", "value"))
    placed = own.withColumns({"z": F.lit(n_genes) - nnz, "r": F.rank().over(cell.orderBy("value")) + (ties - 1) / 2})
    centre = (n_genes + 1) / 2
    at, low = F.col("z") + F.col("r") - centre, (F.col("z") + 1) / 2 - centre
    length = F.sqrt(F.sum(at * at).over(cell) + F.col("z") * low * low)
    low = F.when(F.col("z") > 0, low).otherwise(0.0)
    return placed.select("cell_id", "gene_id", ((at - low) / length).alias("r"), (low / length).alias("zero"))


def rank_votes(ref: DataFrame, query: DataFrame, labels: DataFrame, n_genes: int) -> DataFrame:
    """(cell_id, label, center, v): each query cell's vote for each label of the reference, the product of its
    rank-normalised values with the label's mean ones. As centred ranks sum to zero, only stored values multiply."""
    r = rank_normalised(ref, n_genes).join(labels.withColumnRenamed("label", "center"), "cell_id")
    n = r.select("cell_id", "center", "zero").distinct().groupBy("center").agg(F.count(F.lit(1)).alias("n"), F.sum("zero").alias("base"))
    # At most labels x genes rows.
    means = r.groupBy("center", "gene_id").agg(F.sum("r").alias("s")).join(n, "center").select("center", "gene_id", (F.col("s") / F.col("n")).alias("c"), (F.col("base") / F.col("n")).alias("b"))
    means = staged(means, "means")
    base = means.select("center", "b").distinct()
    total = means.groupBy("center").agg(F.sum("c").alias("c")).join(base, "center").select("center", (F.col("c") + n_genes * F.col("b")).alias("all"), "b")
    asked = staged(rank_normalised(query, n_genes), "asked")
    cells = asked.groupBy("cell_id").agg(F.sum("r").alias("r"), F.first("zero").alias("zero"))
    near = asked.withColumnRenamed("r", "own").join(means.drop("b"), "gene_id").groupBy("cell_id", "center").agg(F.sum(F.col("own") * F.col("c")).alias("v"))
    # The parts that stand for what isn't stored: the query's zeros with all of the centre, and its values with the centre's zeros.
    every = cells.crossJoin(F.broadcast(total)).join(near, ["cell_id", "center"], "left")
    v = F.coalesce("v", F.lit(0.0)) + F.col("r") * F.col("b") + F.col("zero") * F.col("all")
    return every.select("cell_id", "center", F.round(v, 9).alias("v")).join(labels, "cell_id")


def celltype_auroc_ranked(ref: DataFrame, query: DataFrame, labels: DataFrame, n_genes: int) -> DataFrame:
    """(label, center, auroc) by rank-normalised votes."""
    return _auroc(rank_votes(ref, query, labels, n_genes), ["center"])


def one_vs_best(ref: DataFrame, query: DataFrame, labels: DataFrame, n_genes: int) -> DataFrame:
    """(center, best, second, auroc): for each label of the reference the query label that it ranks highest and the
    next (ties to the smaller label), and how well its votes tell the cells of these two apart."""
    votes = staged(rank_votes(ref, query, labels, n_genes), "votes")
    order = Window.partitionBy("center").orderBy(F.desc(F.round("auroc", 9)), "label")
    first = _auroc(votes, ["center"]).withColumn("i", F.row_number().over(order)).where("i <= 2")
    pairs = first.groupBy("center").agg(F.max(F.when(F.col("i") == 1, F.col("label"))).alias("best"), F.max(F.when(F.col("i") == 2, F.col("label"))).alias("second")).where("second is not null")
    own = votes.join(F.broadcast(pairs), "center").where("label = best or label = second").select("center", "label", "v")
    return _auroc(own, ["center"]).join(F.broadcast(pairs), "center").where("label = best").select("center", "best", "second", "auroc")


def cluster_sweep(vectors: DataFrame, settings: list[int], seed: int = 7) -> DataFrame:
    """(k, ari, nmi) of clusterings against the labels; one row for each setting."""
    rows = vectors.select("vec_id", "label", array_to_vector("embedding").alias("features"))
    out = None
    for k in settings:
        said = KMeans(k=k, seed=seed, maxIter=10).fit(rows).transform(rows).select("label", "prediction")
        score = E.ari(said, "label", "prediction").crossJoin(E.nmi(said, "label", "prediction")).select(F.lit(k).alias("k"), "ari", "nmi")
        out = score if out is None else out.unionByName(score)
    if out is None:
        raise ValueError("no settings")
    return out


def log_factorial(n: Column) -> Column:
    """ln n! for whole numbers: Stirling's series from 10 on, to about 1e-13 of the value, products below."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + math.log(2 * math.pi) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    return F.when(n < 10, F.log(F.factorial(F.greatest(n, F.lit(0)).cast("int")).cast("double"))).otherwise(series)


def enrichment(genes: DataFrame, sets: DataFrame, universe: DataFrame, cutoff: float | None = None, top: int | None = None) -> DataFrame:
    """(set, overlap, size, p, q) of a gene list in gene sets: upper tail of the hypergeometric distribution,
    Benjamini-Hochberg over the sets. The numbers of genes are those of a vocabulary. With `cutoff`, the sets whose q
    is below it; with `top`, the first so many by p, then by name."""
    n, drawn = universe.count(), genes.count()
    own = sets.groupBy("set").agg(F.count(F.lit(1)).alias("size"))
    hits = sets.join(genes, "gene_id").groupBy("set").agg(F.count(F.lit(1)).alias("overlap"))
    log_choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    size, drawn_c, n_c = F.col("size"), F.lit(drawn).cast("bigint"), F.lit(n).cast("bigint")
    most = F.least(size, drawn_c)
    # The first term by factorials, each further one by its ratio to the one before.
    first = F.greatest("overlap", size + drawn_c - n_c)
    start = F.exp(log_choose(size, first) + log_choose(n_c - size, drawn_c - first) - log_choose(n_c, drawn_c))
    ratio = lambda i: (size - i + 1) * (drawn_c - i + 1) / (i * (n_c - size - drawn_c + i)).cast("double")
    state = F.struct(start.alias("term"), start.alias("sum"))
    following = F.when(first < most, F.sequence(first + 1, most)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(following, state, lambda s, i: F.struct((s["term"] * ratio(i)).alias("term"), (s["sum"] + s["term"] * ratio(i)).alias("sum")), lambda s: s["sum"])
    scored = staged(own.join(hits, "set").withColumn("p", F.round(tail, 12)), "scores")
    # Steps of equal p: a step's rank is that of its last set, and its q the least p * m / rank from there on.
    steps = scored.groupBy("p").agg(F.count(F.lit(1)).alias("k")).withColumn("all", F.lit(0))
    ranked = running_sums(steps, ["all"], "p", "k").select("p", "before_k", "k", (F.col("p") * F.col("total_k") / (F.col("before_k") + F.col("k"))).alias("raw"))
    w = Window.orderBy(F.desc("p"))  # a row for each distinct p, of as many as there are sets
    q = ranked.withColumn("q", F.least(F.lit(1.0), F.min("raw").over(w))).select("p", "q")
    out = scored.join(q, "p").select("set", "overlap", "size", "p", "q")
    out = out if cutoff is None else out.where(F.col("q") < cutoff)
    return out if top is None else out.orderBy("p", "set").limit(top)


def inject_niche(cells: DataFrame, donors: DataFrame, n: int, spread: float = 1.0, seed: str = "niche") -> DataFrame:
    """(cell_name, cell_type, x, y, injected): the cells, and n donors (without replacement), each near a target
    cell drawn from all with replacement: Gaussian noise of the targets' median distance to their nearest
    neighbour times `spread`."""
    far = S.knn_in_group(cells, 2, ["slice"]).where("rank = 2").select(F.lit(0).alias("all"), F.sqrt("dist2").alias("d"))
    near = quantiles(staged(far, "distances"), "all", "d", (0.5,)).select(F.col("q")[0].alias("d"))
    taken = donors.orderBy(hashed("cell_id", salt=f"{seed}-donor"), "cell_id").limit(n).select("cell_id", "cell_type")
    places, size = X.numbered(cells.select("cell_id", "x", "y"), f"{seed}-place")
    chosen = taken.crossJoin(size).withColumn("k", X.drawn_number("cell_id", f"{seed}-target")).join(places.select("k", "x", "y"), "k").crossJoin(F.broadcast(near))
    radius = F.sqrt(-2 * F.log(F.greatest(hashed("cell_id", salt=f"{seed}-r"), F.lit(1e-12)))) * F.col("d") * spread
    angle = 2 * math.pi * hashed("cell_id", salt=f"{seed}-a")
    new = chosen.select(F.concat(F.col("cell_id").cast("string"), F.lit("_inj")).alias("cell_name"), "cell_type", (F.col("x") + radius * F.cos(angle)).alias("x"), (F.col("y") + radius * F.sin(angle)).alias("y"))
    return X.with_cells(new, cells)


def _in_blocks(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Rows in their hashed block `own`, once for each block of the other side."""
    block = F.floor(hashed("id", salt="ot-block") * n_own).cast("int")
    return rows.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def _log_kernel(rows, others, reg):
    e, f = np.array(rows["e"].tolist()), np.array(others["e"].tolist())
    return -np.maximum((e * e).sum(1)[:, None] + (f * f).sum(1)[None, :] - 2 * e @ f.T, 0.0) / reg


def _scaled(rows: DataFrame, others: DataFrame, logs: DataFrame, reg: float, power: float, n: int, blocks: tuple[int, int]) -> DataFrame:
    """(side, id, log) of the rows: power * (-log n - log sum over the others of kernel * scaling), the sum by
    pairs of blocks."""
    keys = ["side", "r", "o"]
    left = _in_blocks(rows, "r", blocks[0], "o", blocks[1])
    right = _in_blocks(others.join(logs, ["side", "id"]), "o", blocks[1], "r", blocks[0])

    def part(a, b):
        x = _log_kernel(a, b, reg) + b["log"].to_numpy()[None, :] if len(a) and len(b) else np.zeros((0, 1))
        if not len(x):
            return pd.DataFrame({"side": [], "id": [], "l": []}).astype({"side": "int32", "id": "int64", "l": "float64"})
        top = x.max(axis=1)
        return pd.DataFrame({"side": a["side"], "id": a["id"], "l": top + np.log(np.exp(x - top[:, None]).sum(axis=1))})

    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(part, "side int, id long, l double")
    whole = sums.groupBy("side", "id").agg(F.max("l").alias("top"), F.collect_list("l").alias("ls"))
    total = F.col("top") + F.log(F.aggregate("ls", F.lit(0.0), lambda s, l: s + F.exp(l - F.col("top"))))
    return staged(whole.select("side", "id", (F.lit(power) * (F.lit(-math.log(n)) - total)).alias("log")), "scaling")


def shift_ot(young: DataFrame, old: DataFrame, perturbed: DataFrame, reg: float = 1.0, penalty: float = 10.0, tolerance: float = 1e-9, block: int = 1000) -> DataFrame:
    """(vec_id, projection, projection_after, cos_before, cos_after, cos_change, dist_before, dist_after,
    dist_change) of each old vector before and after perturbation: its similarity to its barycentric projection
    from the young ones by an unbalanced Sinkhorn plan of squared Euclidean cost.

    The cost is computed anew each round in pairs of hashed blocks; scalings are tables of logarithms, written
    every round. A projection hangs on the young scalings up to a factor, so rounds end when their logarithms
    change by the same number within the tolerance; each round shrinks the spread by (penalty / (penalty + reg))^2."""
    vectors = lambda df, side: df.select(F.lit(side).alias("side"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    sources = vectors(young, 0).unionByName(vectors(young, 1))
    targets = vectors(old, 0).unionByName(vectors(perturbed, 1))
    ny, no, both = young.count(), old.count(), old.select("vec_id").join(perturbed.select("vec_id"), "vec_id").count()
    if not no == both == perturbed.count():
        raise ValueError("old and perturbed vectors differ in their ids")
    by, bo = -(-ny // block), -(-no // block)
    power = penalty / (penalty + reg)
    v, u, spread = targets.select("side", "id", F.lit(0.0).alias("log")), None, math.inf
    while ny and no and spread > tolerance:
        last, u = u, _scaled(sources, targets, v, reg, power, ny, (by, bo))
        if last is not None:
            step = u.join(last.withColumnRenamed("log", "last"), ["side", "id"]).withColumn("d", F.col("log") - F.col("last"))
            spread = step.groupBy("side").agg((F.max("d") - F.min("d")).alias("s")).agg(F.max("s")).first()[0]
        v = _scaled(targets, sources, u, reg, power, no, (bo, by)) if spread > tolerance else v
    if u is None:
        raise ValueError("no vectors to compare")

    def part(a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"side": [], "id": [], "top": [], "w": [], "p": []}).astype({"side": "int32", "id": "int64", "top": "float64", "w": "float64"})
        x = _log_kernel(a, b, reg) + b["log"].to_numpy()[None, :]
        top = x.max(axis=1)
        w = np.exp(x - top[:, None])
        return pd.DataFrame({"side": a["side"], "id": a["id"], "top": top, "w": w.sum(axis=1), "p": list(w @ np.array(b["e"].tolist()))})

    keys = ["side", "r", "o"]
    left, right = _in_blocks(targets, "r", bo, "o", by), _in_blocks(sources.join(u, ["side", "id"]), "o", by, "r", bo)
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(part, "side int, id long, top double, w double, p array<double>")
    share = F.exp(F.col("top") - F.max("top").over(Window.partitionBy("side", "id")))
    long = parts.withColumn("share", share).select("side", "id", (F.col("share") * F.col("w")).alias("w"), "share", F.posexplode("p").alias("dim", "x"))
    dims = long.groupBy("side", "id", "dim").agg((F.sum(F.col("share") * F.col("x")) / F.sum("w")).alias("x"))
    made = dims.groupBy("side", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("projection"))
    scored = made.join(targets, ["side", "id"]).select("side", "id", "projection", cosine("e", "projection").alias("cos"), F.sqrt(distance2("e", "projection")).alias("dist"))
    a = scored.where("side = 0").select(F.col("id").alias("vec_id"), "projection", F.col("cos").alias("cos_before"), F.col("dist").alias("dist_before"))
    b = scored.where("side = 1").select(F.col("id").alias("vec_id"), F.col("projection").alias("projection_after"), F.col("cos").alias("cos_after"), F.col("dist").alias("dist_after"))
    change = lambda c: [f"{c}_before", f"{c}_after", (F.col(f"{c}_after") - F.col(f"{c}_before")).alias(f"{c}_change")]
    return a.join(b, "vec_id").select("vec_id", "projection", "projection_after", *change("cos"), *change("dist"))


def shift_to_young(before: DataFrame, after: DataFrame, young: str, old: str, cell_type: object, niche: bool = False, by: str = "label", gamma: float = 1.0) -> DataFrame:
    """One row: cos, dist, emd and mmd of a type's old vectors to its young ones, before and after a
    perturbation, and their changes. With `niche`, of all other types. NaN counts as zero; a side without
    vectors is an error."""
    mine = F.col(by) != F.lit(cell_type) if niche else F.col(by) == F.lit(cell_type)
    clean = lambda df, slice_: df.where(mine & (F.col("slice") == slice_)).select(F.transform("embedding", lambda x: F.nanvl(x.cast("double"), F.lit(0.0))).alias("embedding"))
    there = staged(clean(before, young), "young")
    sides = {"before": staged(clean(before, old), "before"), "after": staged(clean(after, old), "after")}
    if any(df.isEmpty() for df in (there, *sides.values())):
        raise ValueError("no vectors to compare")
    out = X.shift_to_reference(sides["before"], sides["after"], centroids(there, []))
    vectors = E.distinct_vectors(there, "vectors")
    own = staged(E.kernel_mean(vectors, None, gamma, "bb"), "own")
    for name, df in sides.items():
        mmd = E.mmd_of_distinct(E.distinct_vectors(df, name), vectors, gamma, own)
        out = out.crossJoin(E.emd_per_dim(df, there).withColumnRenamed("emd", f"emd_{name}")).crossJoin(mmd.withColumnRenamed("mmd", f"mmd_{name}"))
    return out.withColumns({f"{c}_change": F.col(f"{c}_after") - F.col(f"{c}_before") for c in ("cos", "dist", "emd", "mmd")})


def downstream_eval(task: str, **tables: DataFrame) -> DataFrame:
    """The scores of a task by its name."""
    tasks: dict[str, Callable[..., DataFrame]] = {"annotation": E.class_metrics, "denoising": E.denoise_eval, "imputation": E.impute_eval}
    if task not in tasks:
        raise NotImplementedError(task)
    return tasks[task](**tables)


