"""In-silico perturbation of values and tokens, cell injection, and the shifts they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatialis.functions.scalars import cosine, distance2, dot, hashed, norm
from spatialis.operators.qc import drop_other_types
from spatialis.operators.tokens import PAD
from spatialis.operators.transfer import centroids


def perturb_expr(expr: DataFrame, genes: list[int], mode: str, targets: DataFrame | None = None, value: float | None = None, multiplier: float | None = 2.0) -> DataFrame:
    """Knockout: the genes' values go from the target cells. Overexpress: they become `value`, or multiplier
    times the gene's greatest value over all cells, in every target cell. No target cell at all is an error."""
    if targets is not None and targets.isEmpty():
        raise ValueError("no target cells")
    hit = F.col("gene_id").isin(genes)
    cells = (expr if targets is None else targets).select("cell_id").distinct()
    rest = expr.where(~hit).unionByName(expr.where(hit).join(cells, "cell_id", "left_anti"))
    if mode == "knockout":
        return rest
    if mode != "overexpress":
        raise ValueError(f"unknown mode {mode}")
    if value is None and multiplier is None:
        raise ValueError("overexpression needs a value or a multiplier")
    most = expr.where(hit).groupBy("gene_id").agg(F.max("value").alias("most"))
    new = F.lit(float(value)) if value is not None else F.col("most") * multiplier
    return rest.unionByName(cells.crossJoin(F.broadcast(most)).select("cell_id", "gene_id", new.alias("value")))


def delete_tokens(rows: DataFrame, tokens: list[int], column: str = "X", attention: str | None = None) -> DataFrame:
    """Tokens become PAD in their place; in the array `attention`, if named, their places become true."""
    if attention:
        rows = rows.withColumn(attention, F.zip_with(attention, column, lambda a, t: a | t.isin(tokens)))
    return rows.withColumn(column, F.transform(column, lambda t: F.when(t.isin(tokens), F.lit(PAD).cast("bigint")).otherwise(t)))


def perturb_info(tokens: DataFrame, perturbed: list[int], skip: int = 2) -> DataFrame:
    """(cell_id, is_perturbed, ranks, n_perturbed, n_expressed), without the first tokens."""
    own = tokens.where(F.col("pos") >= skip)
    hit = F.col("token").isin(perturbed)
    return own.groupBy("cell_id").agg(F.max(hit).alias("is_perturbed"), F.array_sort(F.collect_list(F.when(hit, F.col("pos")))).alias("ranks"), F.count_if(hit).alias("n_perturbed"), F.count_if(F.col("token") != PAD).alias("n_expressed"))


def keep_perturbed(info: DataFrame) -> DataFrame:
    return info.where("is_perturbed")


def pair_states(before: DataFrame, after: DataFrame, key: str = "cell_id") -> DataFrame:
    """(key, before, after) of those on both sides."""
    return before.select(key, F.col("embedding").alias("before")).join(after.select(key, F.col("embedding").alias("after")), key)


def state_similarity(pairs: DataFrame, key: str = "cell_id") -> DataFrame:
    return pairs.select(key, cosine("before", "after").alias("cosine"), F.sqrt(dot(F.zip_with(F.col("before").cast("array<double>"), F.col("after").cast("array<double>"), lambda a, b: a - b), F.zip_with(F.col("before").cast("array<double>"), F.col("after").cast("array<double>"), lambda a, b: a - b))).alias("l2"))


def token_similarity(before: DataFrame, after: DataFrame, info: DataFrame, skip: int = 2, max_rank: int | None = None) -> DataFrame:
    """(cell_id, token, rank, n_expressed, is_perturbed, is_perturbed_gene, cos_gene, l2_gene, cos_cell): each
    token's vector before and after (cell_id, pos, token, embedding), and the mean vectors of the cell's tokens
    that are no padding. `rank` counts from the first token that isn't skipped; `info` is that of perturb_info."""
    before, after = (df.where(F.col("pos") >= skip) for df in (before, after))
    first, last = (centroids(df.where(F.col("token") != PAD), ["cell_id"]) for df in (before, after))
    cells = first.join(last.withColumnRenamed("centroid", "last"), "cell_id", "left").select("cell_id", cosine("centroid", "last").alias("cos_cell"))
    own = before.where(F.col("token") != PAD).select("cell_id", "pos", "token", F.col("embedding").alias("a"))
    pairs = own.join(after.select("cell_id", "pos", F.col("embedding").alias("b")), ["cell_id", "pos"]).withColumn("rank", F.col("pos") - skip)
    pairs = pairs if max_rank is None else pairs.where(F.col("rank") < max_rank)
    return (
        pairs.join(info.select("cell_id", "is_perturbed", "ranks", "n_expressed"), "cell_id")
        .join(cells, "cell_id")
        .select("cell_id", "token", "rank", "n_expressed", "is_perturbed", F.array_contains("ranks", F.col("pos")).alias("is_perturbed_gene"), cosine("a", "b").alias("cos_gene"), F.sqrt(distance2("a", "b")).alias("l2_gene"), "cos_cell")
    )


def _token_changes(before: DataFrame, after: DataFrame, info: DataFrame, metric: str) -> DataFrame:
    """(cell_id, pos, gene_id, score, change) of perturbed cells with as many tokens before as after."""
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric}")
    size = lambda df: df.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    cells = size(before).join(size(after), ["cell_id", "n"]).join(info.where("is_perturbed"), "cell_id", "left_semi").select("cell_id")
    pairs = before.join(cells, "cell_id", "left_semi").join(after.select("cell_id", "pos", F.col("embedding").alias("b")), ["cell_id", "pos"])
    score = cosine("embedding", "b") if metric == "cosine" else F.sqrt(distance2("embedding", "b"))
    scored = pairs.select("cell_id", "pos", "gene_id", score.alias("score"))
    return scored.withColumn("change", 1 - F.col("score") if metric == "cosine" else F.col("score"))


def gene_impact(before: DataFrame, after: DataFrame, info: DataFrame, metric: str = "cosine", k: int = 10) -> DataFrame:
    """(cell_id, score, top_genes): of each perturbed cell the mean cosine or distance of its genes' vectors
    (cell_id, pos, gene_id, embedding) and the k genes that change most."""
    changes = _token_changes(before, after, info, metric)
    top = top_changed(changes, "cell_id", "gene_id", k).groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("rank", "gene_id"))).alias("t"))
    return changes.groupBy("cell_id").agg(F.avg("score").alias("score")).join(top, "cell_id").select("cell_id", "score", F.transform("t", lambda s: s["gene_id"]).alias("top_genes"))


def gene_change_matrix(before: DataFrame, after: DataFrame, info: DataFrame, metric: str = "cosine", k: int | None = None) -> DataFrame:
    """(gene_id, cell_id, change), of each cell all genes or the k that change most."""
    changes = _token_changes(before, after, info, metric)
    return (changes if k is None else top_changed(changes, "cell_id", "gene_id", k)).select("gene_id", "cell_id", "change")


def top_changed(changes: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The k keys of greatest change in each group."""
    w = Window.partitionBy(by).orderBy(F.desc(F.round("change", 9)), key)
    return changes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gene_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(gene_id, before, after, delta, abs_delta): means over all cells of the two tables, zeros included."""
    cells = before.select("cell_id").union(after.select("cell_id")).agg(F.countDistinct("cell_id").alias("n_cells"))
    total = lambda df, name: df.groupBy("gene_id").agg(F.sum("value").alias(name))
    sums = total(before, "before").join(total(after, "after"), "gene_id", "full_outer").na.fill(0.0, ["before", "after"])
    both = sums.crossJoin(F.broadcast(cells)).select("gene_id", *[(F.col(c) / F.col("n_cells")).alias(c) for c in ("before", "after")])
    delta = F.col("after") - F.col("before")
    return both.withColumns({"delta": delta, "abs_delta": F.abs(delta)})


def top_delta_genes(deltas: DataFrame, n: int, column: str = "abs_delta") -> DataFrame:
    return deltas.orderBy(F.desc(F.round(column, 9)), "gene_id").limit(n)


def top_gene_frequency(top: DataFrame) -> DataFrame:
    """(gene_id, n, percent): how often a gene is among cells' most changed, of the cells that have any."""
    cells = top.agg(F.countDistinct("cell_id").alias("n_cells"))
    counts = top.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(cells))
    return counts.select("gene_id", "n", (100 * F.col("n") / F.col("n_cells")).alias("percent"))


def condition_vectors(conditions: DataFrame, gene_vec: DataFrame, dim: int) -> DataFrame:
    """(condition, vector): the mean vector of the condition's genes (split at + - / | &); controls are
    zeros, unknown genes count as zeros. Names match as they are, else in lower case."""
    zero = F.array_repeat(F.lit(0.0), dim)
    names = F.filter(F.transform(F.split("condition", r"[+\-/|&]"), lambda g: F.trim(g)), lambda g: g != "")
    parts = conditions.select("condition").distinct().withColumn("gene", F.explode_outer(names)).withColumn("low", F.lower("gene"))
    one = gene_vec.groupBy("gene_symbol").agg(F.min(F.struct("gene_id", "embedding"))["embedding"].alias("e"))
    low = gene_vec.groupBy(F.lower("gene_symbol").alias("low")).agg(F.min(F.struct("gene_id", "embedding"))["embedding"].alias("f"))
    found = parts.join(one.withColumnRenamed("gene_symbol", "gene"), "gene", "left").join(low, "low", "left")
    vector = F.when(F.col("low").isin("ctrl", "control"), zero).otherwise(F.coalesce(F.col("e").cast("array<double>"), F.col("f").cast("array<double>"), zero))
    long = found.select("condition", F.posexplode(vector).alias("dim", "v")).groupBy("condition", "dim").agg(F.avg("v").alias("v"))
    return long.groupBy("condition").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("vector"))


def numbered(donors: DataFrame, salt: str, buckets: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The donors with `k` from 0, in the order of a hash and cell_id, and their number `m` as one row. Buckets
    of the hash, of a fixed number, are numbered each by itself and begin after the counts of those before."""
    own = donors.withColumn("h", hashed("cell_id", salt=salt)).withColumn("bucket", F.floor(F.col("h") * buckets))
    counts = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "cell_id")) - 1
    placed = own.withColumn("place", place).join(F.broadcast(starts), "bucket").withColumn("k", F.col("start") + F.col("place"))
    return placed.drop("h", "bucket", "place", "start"), F.broadcast(donors.agg(F.count(F.lit(1)).alias("m")))


def drawn_number(key: str, salt: str):
    """A number from 0 below `m`; without donors there is nothing to draw."""
    return F.when(F.col("m") > 0, F.floor(hashed(key, salt=salt) * F.col("m"))).otherwise(F.raise_error(F.lit("no donors")).cast("bigint"))


def inject_random(cells: DataFrame, donors: DataFrame, n: int, seed: str = "inject") -> DataFrame:
    """(cell_name, cell_type, x, y, injected): the cells, and n drawn from all donors with replacement, placed
    uniformly in the cells' bounding box. Donors are numbered by hash, so the draw is an equi join on a number."""
    pool, size = numbered(donors, f"{seed}-order")
    box = F.broadcast(cells.agg(*[f(c).alias(f"{k}{c}") for c in ("x", "y") for k, f in (("lo", F.min), ("hi", F.max))]))
    draws = cells.sparkSession.range(n).crossJoin(size).withColumn("k", drawn_number("id", f"{seed}-donor")).drop("m")
    at = lambda c: F.col(f"lo{c}") + hashed("id", salt=f"{seed}-{c}") * (F.col(f"hi{c}") - F.col(f"lo{c}"))
    new = draws.join(pool.select("k", "cell_id", "cell_type"), "k").crossJoin(box).select(F.concat(F.col("cell_id").cast("string"), F.lit("_inj"), F.col("id").cast("string")).alias("cell_name"), "cell_type", at("x").alias("x"), at("y").alias("y"))
    return with_cells(new, cells)


def with_cells(injected: DataFrame, cells: DataFrame) -> DataFrame:
    """The injected cells and those that were there, marked by `injected`."""
    there = cells.select(F.col("cell_id").cast("string").alias("cell_name"), "cell_type", "x", "y", F.lit(False).alias("injected"))
    return injected.withColumn("injected", F.lit(True)).unionByName(there)


def inject_replace(cells: DataFrame, cell_type: str, donors: DataFrame, seed: str = "replace") -> DataFrame:
    """(cell_id, x, y, donor_id): all cells of a type keep their place and get the identity of a donor of that
    type, drawn with replacement; the others stay."""
    pool, size = numbered(donors.where(F.col("cell_type") == cell_type), f"{seed}-order")
    drawn = cells.where(F.col("cell_type") == cell_type).crossJoin(size).withColumn("k", drawn_number("cell_id", seed)).join(pool.select("k", F.col("cell_id").alias("donor_id")), "k").select("cell_id", "x", "y", "donor_id")
    return cells.where(F.col("cell_type") != cell_type).select("cell_id", "x", "y", F.lit(None).cast("bigint").alias("donor_id")).unionByName(drawn)


def shift_to_reference(before: DataFrame, after: DataFrame, center: DataFrame) -> DataFrame:
    """One row: mean cosine and distance to a centroid, before and after."""
    side = lambda df, n: df.crossJoin(F.broadcast(center)).agg(F.avg(cosine("embedding", "centroid")).alias(f"cos_{n}"), F.avg(F.sqrt(distance2("embedding", "centroid"))).alias(f"dist_{n}"))
    return side(before, "before").crossJoin(side(after, "after"))


def unit_centroid(vectors: DataFrame) -> DataFrame:
    """One row, `centroid`: the mean of the vectors at length one, itself at length one."""
    unit = lambda c: F.transform(F.col(c).cast("array<double>"), lambda x: x / F.coalesce(F.nullif(norm(c), F.lit(0.0)), F.lit(1.0)))
    return centroids(vectors.select(unit("embedding").alias("embedding")), []).select(unit("centroid").alias("centroid"))


def delta_cosine(vectors: DataFrame, center: DataFrame, baseline: DataFrame, by: str = "cell_type") -> DataFrame:
    """Each vector's cosine to the centroid less the baseline's mean of its type."""
    scored = lambda df: df.crossJoin(F.broadcast(center)).withColumn("c", dot("embedding", "centroid") / F.nullif(norm("embedding") * norm("centroid"), F.lit(0.0)))
    base = scored(baseline).groupBy(by).agg(F.avg("c").alias("base"))
    return scored(drop_other_types(vectors) if by == "cell_type" else vectors).join(base, by).withColumn("delta", F.col("c") - F.col("base")).drop("centroid", "c", "base")


def centroid_coords(vectors: DataFrame, young: DataFrame, old: DataFrame, by: str | None = None) -> DataFrame:
    """Cosines to two centroids, of each vector or, with `by`, their means over each type."""
    if by is not None:
        return centroid_coords(vectors, young, old).join(vectors.select("vec_id", by), "vec_id").groupBy(by).agg(*[F.avg(c).alias(c) for c in ("cos_young", "cos_old")])
    both = vectors.crossJoin(F.broadcast(young.select(F.col("centroid").alias("cy")))).crossJoin(F.broadcast(old.select(F.col("centroid").alias("co"))))
    return both.select("vec_id", cosine("embedding", "cy").alias("cos_young"), cosine("embedding", "co").alias("cos_old"))


def perturb_covariates(cells: DataFrame, perturbed: DataFrame) -> DataFrame:
    """perturb_flag and perturb_gene_id of each cell, 0 and null without a perturbation."""
    return cells.join(perturbed.select("cell_id", "perturb_gene_id"), "cell_id", "left").withColumn("perturb_flag", F.col("perturb_gene_id").isNotNull().cast("int"))


def n_conditions(covariates: DataFrame) -> DataFrame:
    """One row: how many genes are perturbed in some cell; cells without a perturbation are no condition."""
    return covariates.agg(F.countDistinct("perturb_gene_id").alias("n_conditions"))
