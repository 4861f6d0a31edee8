"""Label transfer between reference and query vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatialis.functions.scalars import cosine, distance2
from spatialis.operators.inverted import approximate_neighbours
from spatialis.sources.staging import staged

#: Rows of a reference block and of a query block in exact search, and distances held at a time.
REF_BLOCK, QUERY_BLOCK, CELLS = 65_536, 8192, 1 << 22


def centroids(vectors: DataFrame, by: list[str], embedding: str = "embedding") -> DataFrame:
    """The mean vector of each group, `centroid`."""
    rows = vectors.where(F.col(embedding).isNotNull()).select(*by, array_to_vector(embedding).alias("v"))
    return rows.groupBy(*by).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("centroid"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long arrays as one matrix of doubles."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64, copy=False)


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, dist) of each query's k nearest rows by distances rounded to 9 decimals, then ids. Products of
    matrices tell which rows can be among them; only those get their distance as differences give it."""
    euclidean, finite = metric == "euclidean", lambda x: np.where(np.isfinite(x), x, 0)
    norms, own = (x * x).sum(axis=1), (q * q).sum(axis=1)
    columns = np.ascontiguousarray((x if euclidean else x / np.sqrt(norms)[:, None]).T)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    some = max(1, CELLS // max(1, len(x)))
    for i in range(0, len(q), some):
        v = q[i : i + some]
        if euclidean:
            about = own[i : i + some, None] + norms[None] - 2 * (v @ columns)
            slack = 1e-12 * (finite(own[i : i + some]) + finite(norms).max(initial=0))
        else:
            about = 1 - (v / np.sqrt(own[i : i + some])[:, None]) @ columns
            slack = np.full(len(v), 1e-12)
        np.nan_to_num(about, copy=False, nan=np.inf)
        most = np.full(len(v), np.inf)
        if len(x) > k:
            # The k-th of some rows bounds that of all; few rows lie below it.
            first = about[:, : max(k, min(len(x), 4096))]
            most = np.partition(first, k - 1, axis=1)[:, k - 1]
        row, column = np.nonzero(about <= _looser(most, slack, euclidean)[:, None])
        near = about[row, column]
        if len(x) > k:
            order = np.lexsort((near, row))
            start = np.searchsorted(row[order], np.arange(len(v)))
            row, column, near = row[order], column[order], near[order]
            keep = near <= _looser(near[start + k - 1], slack, euclidean)[row]
            row, column = row[keep], column[keep]
        exact = np.empty(len(row))
        for j in range(0, len(row), CELLS // 64):
            a, b = v[row[j : j + CELLS // 64]], x[column[j : j + CELLS // 64]]
            exact[j : j + CELLS // 64] = np.sqrt(((b - a) ** 2).sum(axis=1)) if euclidean else 1 - (a * b).sum(axis=1) / np.sqrt((b * b).sum(axis=1) * (a * a).sum(axis=1))
        exact = np.nan_to_num(exact, nan=np.inf)
        order = np.lexsort((ids[column], np.round(exact, 9), row))
        row, column, exact = row[order], column[order], exact[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((row[keep] + i, column[keep], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _looser(most: np.ndarray, slack: np.ndarray, euclidean: bool) -> np.ndarray:
    """A bound on (squared) distances that outweighs their errors and those of rounding distances to 9 decimals."""
    return most + slack + (4e-9 * np.sqrt(np.maximum(most + slack, 0)) + 4e-18 if euclidean else 4e-9)


def top_neighbours(ref: DataFrame, query: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(query_id, vec_id, label, rank, dist): each query's k nearest reference rows, ties to the smaller id.

    Both sides are dealt into blocks of a fixed size, a task for each pair of blocks, whose products of matrices
    leave k rows of each query; these are ranked together. Work grows with the product of both sides, memory
    doesn't: reference rows are copied for each QUERY_BLOCK queries, and queries for each REF_BLOCK rows."""
    n_ref = max(1, -(-ref.count() // REF_BLOCK))
    n_query = max(1, -(-query.count() // QUERY_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    r = ref.where("embedding is not null").select("vec_id", "label", F.col("embedding").alias("e")).withColumn("rb", block("vec_id", n_ref)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    q = query.where("embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("e")).withColumn("qb", block("query_id", n_query)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_ref - 1))))

    def nearest(asked: pa.Table, there: pa.Table) -> pa.Table:
        ids = there["vec_id"].to_numpy()
        own, row, dist = [], [], []
        if asked.num_rows and there.num_rows:
            with np.errstate(all="ignore"):
                own, row, dist = _nearest(matrix(asked["e"]), matrix(there["e"]), ids, k, metric)
        own, row = pa.array(own, pa.int64()), pa.array(row, pa.int64())
        return pa.table({"query_id": asked["query_id"].take(own), "vec_id": there["vec_id"].take(row), "label": there["label"].take(row), "dist": pa.array(dist, pa.float64())})

    types = f"query_id long, vec_id long, label {ref.schema['label'].dataType.simpleString()}, dist double"
    pairs = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(nearest, types).withColumn("dist", F.round("dist", 9))
    every = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k).select("query_id", "vec_id", "label", "rank", "dist")


def knn_vote(near: DataFrame, weighted: bool = True) -> DataFrame:
    """(query_id, pred): the label of most weight, 1 / distance or 1; neighbours at distance zero take all;
    ties to the smallest label."""
    exact = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("query_id")) == 1
    weight = F.when(exact, (F.col("dist") == 0).cast("double")).otherwise(1 / F.col("dist")) if weighted else F.lit(1.0)
    votes = near.withColumn("w", weight).groupBy("query_id", "label").agg(F.round(F.sum("w"), 9).alias("w"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("pred"))


def knn_unassigned(near: DataFrame, votes: DataFrame, k: int, threshold: float, metric: str = "euclidean") -> DataFrame:
    """`pred` as text, 'unassigned' where the weighted mean similarity of the first floor(sqrt(k))
    neighbours is below the threshold."""
    t = max(1, int(k**0.5))
    edges = F.broadcast(near.agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")))
    sim = 1 - F.col("dist") if metric == "cosine" else 1 - (F.col("dist") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8)
    w = 1 / (F.col("dist") + 1e-8)
    mean = near.where(F.col("rank") <= t).crossJoin(edges).groupBy("query_id").agg((F.sum(w * sim) / F.sum(w)).alias("sim"))
    return votes.join(mean, "query_id").select("query_id", F.when(F.round("sim", 9) < threshold, "unassigned").otherwise(F.col("pred").cast("string")).alias("pred"))


def ann_vote(ref: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Plain majority of approximate neighbours, by inverted lists of quantised codes."""
    return knn_vote(approximate_neighbours(ref, query, k), weighted=False)


def nearest_centroid(centers: DataFrame, query: DataFrame, metric: str = "euclidean") -> DataFrame:
    """The label of the nearest centroid, ties to the smallest label. Labels are few: their centroids are one row
    that goes to every task, and a query finds its best in place."""
    table = F.broadcast(centers.agg(F.collect_list(F.struct("label", "centroid")).alias("centers")))
    score = (lambda c: -distance2("embedding", c)) if metric == "euclidean" else (lambda c: cosine("embedding", c))
    scored = F.transform("centers", lambda c: F.struct(F.round(score(c["centroid"]), 9).alias("score"), (-c["label"]).alias("order"), c["label"].alias("label")))
    best = F.array_max(F.filter(scored, lambda s: s["score"].isNotNull()))
    # A vector without a score for any centroid, such as one of zeros under the cosine, has the smallest label.
    least = F.array_min(F.transform("centers", lambda c: c["label"]))
    return query.select(F.col("vec_id").alias("query_id"), "embedding").crossJoin(table).select("query_id", F.coalesce(best["label"], least).alias("pred"))


def logreg(ref: DataFrame, query: DataFrame, c: float = 1.0, max_iter: int = 200) -> DataFrame:
    """Multinomial logistic regression of penalty 1 / c."""
    vec = lambda df: df.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("features"))
    train = vec(ref)
    model = LogisticRegression(regParam=1.0 / (c * train.count()), maxIter=max_iter, family="multinomial", standardization=False).fit(train)
    return model.transform(vec(query)).select(F.col("vec_id").alias("query_id"), F.col("prediction").cast("int").alias("pred"))


def label_transfer(ref: DataFrame, query: DataFrame, method: str = "native", k: int = 30, metric: str = "euclidean") -> DataFrame:
    if method == "native":
        return knn_vote(top_neighbours(ref, query, k, metric))
    if method == "flat":
        return knn_vote(top_neighbours(ref, query, k, metric), weighted=False)
    if method == "ann":
        return ann_vote(ref, query, k)
    if method == "prototype":
        return nearest_centroid(centroids(ref, ["label"]), query, metric)
    if method == "logreg":
        return logreg(ref, query)
    raise ValueError(f"unknown method {method}")


def scale_pca(vectors: DataFrame, n: int, clip: float = 10.0) -> DataFrame:
    """(vec_id, pc): components of z-scored, clipped vectors."""
    rows = vectors.where("embedding is not null").select("vec_id", array_to_vector("embedding").alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True).fit(rows).transform(rows)
    clipped = scaled.select("vec_id", array_to_vector(F.transform(vector_to_array("z"), lambda x: F.least(F.lit(clip), x))).alias("v"))
    return PCA(k=n, inputCol="v", outputCol="p").fit(clipped).transform(clipped).select("vec_id", vector_to_array("p").alias("pc"))


def marker_dict(markers: DataFrame, cutoff: float, n: int) -> DataFrame:
    """The n strongest markers of each class above the cutoff."""
    w = Window.partitionBy("class").orderBy(F.desc(F.round("weight", 9)), "gene_id")
    return markers.where(F.col("weight") > cutoff).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def marker_score(expr: DataFrame, markers: DataFrame) -> DataFrame:
    """(cell_id, class, score): weighted mean of log1p(1e4 * value / library) over a class's markers that the
    data has; cells without any are absent, their score is 0."""
    there = markers.join(expr.select("gene_id").distinct(), "gene_id", "left_semi")
    weight = there.groupBy("class").agg(F.sum("weight").alias("total"))
    lib = expr.groupBy("cell_id").agg(F.sum("value").alias("lib"))
    v = F.log1p(F.col("value") * 1e4 / F.when(F.col("lib") == 0, 1.0).otherwise(F.col("lib")))
    sums = expr.join(there, "gene_id").join(lib, "cell_id").groupBy("cell_id", "class").agg(F.sum(F.col("weight") * v).alias("s"))
    return sums.join(F.broadcast(weight), "class").select("cell_id", "class", (F.col("s") / (F.col("total") + 1e-8)).alias("score"))


def decode_argmax(logits: DataFrame, codes: DataFrame, column: str = "logits") -> DataFrame:
    """`label` of the first greatest logit."""
    return logits.withColumn("code", F.array_position(column, F.array_max(column)).cast("int") - 1).join(F.broadcast(codes), "code")
