"""Tables and scores that compare labels, matrices and sets of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialis.operators.normalize import log_normalize
from spatialis.operators.running import running_sums
from spatialis.operators.transfer import centroids, matrix
from spatialis.sources.staging import staged

#: Distinct vectors of a block of which all pairs are met.
KERNEL_BLOCK = 16_384


def confusion(df: DataFrame, true: str = "truth", pred: str = "pred") -> DataFrame:
    """(truth, pred, n, share): counts and shares of the true label."""
    n = df.groupBy(F.col(true).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def layer_distribution(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts, row-normalised, then column-normalised."""
    n = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    by_row = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(row)))
    total = F.sum("p").over(Window.partitionBy(column))
    return by_row.select(row, column, F.when(total == 0, F.col("p")).otherwise(F.col("p") / total).alias("p"))


def label_proportions(df: DataFrame, true: str = "truth", pred: str = "pred") -> DataFrame:
    shares = lambda c, n: df.groupBy(F.col(c).alias("label")).agg(F.count(F.lit(1)).alias(n))
    both = shares(true, "a").join(shares(pred, "b"), "label", "full_outer").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("n"))))
    return both.select("label", (F.coalesce("a", F.lit(0)) / F.col("n")).alias("true_share"), (F.coalesce("b", F.lit(0)) / F.col("n")).alias("pred_share"))


def class_report(df: DataFrame, true: str = "truth", pred: str = "pred") -> DataFrame:
    """label, precision, recall, f1, support."""
    pairs = df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    support = pairs.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"))
    said = pairs.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    right = pairs.where("t = p").select(F.col("t").alias("label"), F.col("n").alias("tp"))
    own = support.join(said, "label", "full_outer").join(right, "label", "left").na.fill(0, ["support", "said", "tp"])
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    return own.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support", "tp")


def class_metrics(df: DataFrame, true: str = "truth", pred: str = "pred") -> DataFrame:
    """One row: accuracy, macro averages, support-weighted f1."""
    rep = class_report(df, true, pred)
    return rep.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def ari(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index."""
    pairs = lambda c: c * (c - 1) / 2
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    both = n.agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    one = lambda c, name: n.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m"))).alias(name))
    s = both.crossJoin(one(a, "i")).crossJoin(one(b, "j"))
    expected = F.col("i") * F.col("j") / pairs(F.col("n"))
    return s.select(((F.col("ij") - expected) / ((F.col("i") + F.col("j")) / 2 - expected)).alias("ari"))


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: normalised mutual information, arithmetic mean."""
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    na, nb = (n.groupBy(c).agg(F.sum("n").alias(k)) for c, k in ((a, "na"), (b, "nb")))
    p = F.col("n") / F.col("total")
    mutual = n.join(na, a).join(nb, b).crossJoin(total).agg(F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda t, c, name: t.crossJoin(total).agg((-F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total")))).alias(name))
    return mutual.crossJoin(entropy(na, "na", "ha")).crossJoin(entropy(nb, "nb", "hb")).select((2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"))


def _sums(pred: DataFrame, true: DataFrame, by: str, relu: bool) -> DataFrame:
    """Sums over the entries of each `by`; entries absent on both sides add zeros to n alone."""
    other = "gene_id" if by == "cell_id" else "cell_id"
    own = pred.select("cell_id", "gene_id", F.col("value").alias("p")).join(true.select("cell_id", "gene_id", F.col("value").alias("t")), ["cell_id", "gene_id"], "full_outer")
    p, t = F.coalesce("p", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    p = F.greatest(p, F.lit(0.0)) if relu else p
    n = F.broadcast(true.agg(F.countDistinct(other).alias("n")))
    s = own.groupBy(by).agg(F.sum(p).alias("sp"), F.sum(t).alias("st"), F.sum(p * p).alias("spp"), F.sum(t * t).alias("stt"), F.sum(p * t).alias("spt"), F.sum((p - t) * (p - t)).alias("se"), F.sum(F.abs(p - t)).alias("ae"))
    return s.crossJoin(n)


def _scores() -> dict[str, Column]:
    n, sp, st, spp, stt, spt = (F.col(c) for c in ("n", "sp", "st", "spp", "stt", "spt"))
    vp, vt = n * spp - sp * sp, n * stt - st * st
    return {
        "mse": F.col("se") / n,
        "rmse": F.sqrt(F.col("se") / n),
        "mae": F.col("ae") / n,
        "corr": F.when((vp > 1e-9) & (vt > 1e-9), (n * spt - sp * st) / F.sqrt(vp * vt)).otherwise(0.0),
        "cosine": F.when((spp > 0) & (stt > 0), spt / F.sqrt(spp * stt)).otherwise(0.0),
    }


def unassigned_ratio(votes: DataFrame, column: str = "pred") -> DataFrame:
    """One row: the percentage of votes that are 'unassigned'."""
    return votes.agg((100 * F.avg((F.col(column) == "unassigned").cast("int"))).alias("ratio"))


def impute_eval(pred: DataFrame, true: DataFrame, by: str = "gene_id", relu: bool = True) -> DataFrame:
    """One row: mean over genes (or cells) of mse, rmse, mae, corr, cosine, zeros included."""
    return _sums(pred, true, by, relu).agg(*[F.avg(c).alias(k) for k, c in _scores().items()])


def pearson_rows(pred: DataFrame, true: DataFrame, log: bool = False) -> DataFrame:
    """One row: the mean over cells of the correlation over all genes, of log1p of the values with `log`."""
    if log:
        pred, true = (df.withColumn("value", F.log1p("value")) for df in (pred, true))
    return _sums(pred, true, "cell_id", False).agg(F.avg(_scores()["corr"]).alias("pearson"))


def pearson_1d(pairs: DataFrame) -> DataFrame:
    """One row: the correlation of all entries (pred, true)."""
    return pairs.agg(F.corr("pred", "true").alias("pearson"))


def denoise_matrices(pred: DataFrame, true: DataFrame, mask: DataFrame | None = None, normalize: bool = True) -> DataFrame:
    """One row: mse, rmse, mae, corr, cosine of values, normalised to 1e4 a cell and log1p with `normalize`. With
    a mask (cell_id, gene_id) over its entries; else errors over all cells and genes of `true`, correlation and
    cosine by cell and averaged."""
    if normalize:
        pred, true = (log_normalize(df).withColumn("value", F.greatest("value", F.lit(0.0))) for df in (pred, true))
    if mask is None:
        s = _sums(pred, true, "cell_id", False).agg(*[F.avg(c).alias(k) for k, c in _scores().items() if k != "rmse"])
        return s.select("mse", F.sqrt("mse").alias("rmse"), "mae", "corr", "cosine")
    value = lambda df, name: df.select("cell_id", "gene_id", F.col("value").alias(name))
    pairs = mask.select("cell_id", "gene_id").join(value(pred, "pred"), ["cell_id", "gene_id"], "left").join(value(true, "true"), ["cell_id", "gene_id"], "left")
    return denoise_eval(pairs.na.fill(0.0, ["pred", "true"]))


def denoise_eval(pairs: DataFrame) -> DataFrame:
    """One row over entries (pred, true): mse, rmse, mae, corr, cosine."""
    e = F.col("pred") - F.col("true")
    return pairs.agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.corr("pred", "true").alias("corr"),
        (F.sum(F.col("pred") * F.col("true")) / F.sqrt(F.sum(F.col("pred") * F.col("pred")) * F.sum(F.col("true") * F.col("true")))).alias("cosine"),
    )


def emd_per_dim(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the mean over dimensions of the one-dimensional Wasserstein distance of two sets."""
    long = lambda df, s: df.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "v")).withColumn("s", F.lit(s))
    n = F.broadcast(a.agg(F.count(F.lit(1)).alias("na")).crossJoin(b.agg(F.count(F.lit(1)).alias("nb"))))
    steps = long(a, 1).unionByName(long(b, 0)).groupBy("dim", "v").agg(F.sum("s").alias("ka"), F.sum(1 - F.col("s")).alias("kb")).crossJoin(n)
    placed = running_sums(steps, ["dim"], "v", "ka", "kb")
    gap = F.abs((F.col("before_ka") + F.col("ka")) / F.col("na") - (F.col("before_kb") + F.col("kb")) / F.col("nb"))
    return placed.withColumn("d", gap * (F.col("following") - F.col("v"))).groupBy("dim").agg(F.sum("d").alias("d")).agg(F.avg("d").alias("emd"))


def distinct_vectors(df: DataFrame, name: str) -> DataFrame:
    """(e, w): the distinct vectors and their numbers, written."""
    return staged(df.where("embedding is not null").groupBy(F.col("embedding").cast("array<double>").alias("e")).agg(F.count(F.lit(1)).cast("double").alias("w")), name)


def block_pairs(a: DataFrame, b: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Both sides' vectors in their blocks (i, j), once for each block of the other side; of one table alone only
    blocks with j from i on."""
    na = max(1, -(-a.count() // KERNEL_BLOCK))
    nb = na if b is None else max(1, -(-b.count() // KERNEL_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("e"), F.lit(n)).cast("int")
    every = lambda low, high: F.explode(F.sequence(low, high))
    # Columns of their own: a cogroup takes those of one table for the same on both sides.
    apart = (a if b is None else b).select(F.col("e").alias("e"), F.col("w").alias("w"))
    own, other = a.withColumn("i", block(na)), apart.withColumn("j", block(nb))
    return own.withColumn("j", every(F.lit(0) if b is not None else F.col("i"), F.lit(nb - 1))), other.withColumn("i", every(F.lit(0), F.lit(na - 1) if b is not None else F.col("j")))


def kernel_mean(a: DataFrame, b: DataFrame | None, gamma: float, name: str) -> DataFrame:
    """One row: the mean of the Gaussian kernel over all pairs of two tables (e, w), or of one with itself, in pairs of
    blocks of about KERNEL_BLOCK vectors. A pair of one table's blocks is met once and counts twice."""
    own, other = block_pairs(a, b)
    one = b is None

    def part(x: pa.Table, y: pa.Table) -> pa.Table:
        total, n = [], []
        if x.num_rows and y.num_rows:
            e, f, v, w = matrix(x["e"]), matrix(y["e"]), x["w"].to_numpy(), y["w"].to_numpy()
            twice = 2.0 if one and x["i"][0].as_py() != x["j"][0].as_py() else 1.0
            columns, norms, s = np.ascontiguousarray(f.T), (f * f).sum(axis=1), 0.0
            for k in range(0, len(e), 256):
                d2 = np.maximum((e[k : k + 256] ** 2).sum(axis=1)[:, None] + norms[None] - 2 * (e[k : k + 256] @ columns), 0.0)
                s += v[k : k + 256] @ np.exp(-gamma * d2) @ w
            total, n = [twice * s], [twice * v.sum() * w.sum()]
        return pa.table({"s": pa.array(total, pa.float64()), "n": pa.array(n, pa.float64())})

    sums = own.groupBy("i", "j").cogroup(other.groupBy("i", "j")).applyInArrow(part, "s double, n double")
    return sums.agg((F.sum("s") / F.sum("n")).alias(name))


def mmd_rbf(a: DataFrame, b: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: mean k(a, a) + mean k(b, b) - 2 mean k(a, b), in pairs of blocks. Equal vectors are one, with their
    number as weight."""
    return mmd_of_distinct(distinct_vectors(a, "a"), distinct_vectors(b, "b"), gamma)


def mmd_of_distinct(a: DataFrame, b: DataFrame, gamma: float = 1.0, bb: DataFrame | None = None) -> DataFrame:
    """`mmd_rbf` of tables (e, w); `bb` is b's own mean, if it is known."""
    every = kernel_mean(a, None, gamma, "aa").crossJoin(kernel_mean(b, None, gamma, "bb") if bb is None else bb).crossJoin(kernel_mean(a, b, gamma, "ab"))
    return every.select((F.col("aa") + F.col("bb") - 2 * F.col("ab")).alias("mmd"))


def _covariance(vectors: DataFrame, name: str) -> DataFrame:
    """(i, j, name): sample covariances of dimensions. A task sums the products of its vectors, less the mean of
    all, so that one row for each pair of dimensions leaves it."""
    rows = vectors.where("embedding is not null").select("embedding")
    center = centroids(rows, []).first()
    mean = np.array([] if center is None or center["centroid"] is None else center["centroid"], np.float64)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, whole = 0, np.zeros(len(mean)), np.zeros((len(mean), len(mean)))
        for b in batches:
            if len(b):
                x = np.array(b["embedding"].tolist(), np.float64) - mean
                n, total, whole = n + len(x), total + x.sum(axis=0), whole + x.T @ x
        if n:
            i, j = np.indices(whole.shape).reshape(2, -1)
            yield pd.DataFrame({"i": i, "j": j, "n": n, "si": total[i], "sj": total[j], "s": whole.ravel()})

    sums = rows.mapInPandas(products, "i int, j int, n long, si double, sj double, s double")
    whole = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "s")])
    return whole.where("n > 1").select("i", "j", ((F.col("s") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias(name))


def coral(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the mean squared difference of the two covariance matrices (n - 1)."""
    gap = F.col("ca") - F.col("cb")
    return _covariance(a, "ca").join(_covariance(b, "cb"), ["i", "j"]).agg(F.avg(gap * gap).alias("coral"))
