"""Exact top-k search by inner product of integer vectors, by pivot-table elimination.

PIVOTS vectors are chosen from a sample of at most SAMPLE rows, each as far as can be from those before
it. A table holds every vector's distance to each pivot. For a query q and a candidate x, the largest of
|d(q, p) - d(x, p)| bounds d(q, x) from below, hence (|q|^2 + |x|^2 - bound^2) / 2 bounds their inner
product from above. Candidates are evaluated in the order of that bound until it falls below the k-th
best score found: nothing that is left can enter, not even by a tie.

Queries and candidates are dealt into blocks, a task for each pair of blocks, so neither side has to fit
anywhere whole; the blocks' best are merged by query.

Rows with a null id or a vector that is null, empty or holds null or non-finite components take no part.
Only vectors of equal length are compared. A query never finds rows of its own id. Rows that share an id
are one to a search: it is found once, at its highest score, and asks with each of its vectors. Ties go
to the smaller id. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialis.llm.vectors import best, blocks, matrix, usable

PIVOTS, SAMPLE = 48, 2048
#: Rows of a block of candidates and of queries: some 30 MB each in a task. Candidates are copied once for
#: each block of queries, and queries once for each block of candidates.
BLOCK, QUERY_BLOCK = 32_768, 32_768
RESULT = "query_id long, vec_id long, score long"


def far_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """At most n distinct rows of the sample: the first, then always the one farthest from those taken."""
    taken = sample[:1]
    gap = ((sample - taken) ** 2).sum(axis=1)
    while len(taken) < min(n, len(sample)) and gap.max() > 0:
        taken = np.concatenate([taken, sample[[gap.argmax()]]])
        gap = np.minimum(gap, ((sample - taken[-1]) ** 2).sum(axis=1))
    return taken


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * (x @ pivots.T), 0))


def best_of_block(q: np.ndarray, q_table: np.ndarray, q_id: np.ndarray, x: np.ndarray, table: np.ndarray, x_id: np.ndarray, k: int) -> tuple[list, list, list]:
    """Each query's k best of one block: query ids, vector ids, scores."""
    order = np.argsort(x_id, kind="stable")
    x, table, x_id = x[order], table[order], x_id[order]
    columns, whole = np.ascontiguousarray(table.T), x.astype(np.float64)
    norms = (whole**2).sum(axis=1)
    out: tuple[list, list, list] = ([], [], [])
    for i in range(len(q)):
        own = float((q[i].astype(np.float64) ** 2).sum())
        gap = np.zeros(len(x))
        for p in range(len(columns)):
            np.maximum(gap, np.abs(columns[p] - q_table[i, p]), out=gap)
        # The distances are rounded; the slack outweighs that.
        bound = (own + norms - np.maximum(gap - 1e-6 * (1 + gap), 0) ** 2) / 2 + 1e-9 * (own + norms) + 0.5
        bound[x_id == q_id[i]] = -np.inf
        by_bound = np.argsort(-bound, kind="stable")
        found, scores, at, size = np.empty(0, np.int64), np.empty(0, np.int64), 0, 128
        while at < len(by_bound) and bound[by_bound[at]] > -np.inf and (len(scores) < k or bound[by_bound[at]] >= scores[k - 1]):
            part = by_bound[at : at + size]
            part = part[bound[part] > -np.inf]
            found, scores = np.concatenate([found, part]), np.concatenate([scores, x[part] @ q[i]])
            keep = np.lexsort((found, -scores))  # positions are in the order of ids
            keep = keep[np.sort(np.unique(x_id[found[keep]], return_index=True)[1])[:k]]
            found, scores, at, size = found[keep], scores[keep], at + size, size * 2
        out[0].extend([int(q_id[i])] * len(found))
        out[1].extend(x_id[found].tolist())
        out[2].extend(scores.tolist())
    return out


def pivot_top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of floor(scale * component)
    for each row of `queries` over all rows of `vectors` but those of its own id."""
    spark = vectors.sparkSession
    whole = lambda df: usable(df, vec_id, embedding, zero=True).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    data = whole(vectors)
    sample = data.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(SAMPLE).toArrow()["v"].to_pylist()
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    pivots = {n: far_pivots(np.array(v, np.float64), PIVOTS) for n, v in by_size.items()}
    n_rows = data.count()
    asked = whole(queries).distinct()
    n_queries = asked.count()
    n_blocks, n_query_blocks = max(1, -(-n_rows // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))

    def table(batches):
        for b in batches:
            sizes = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes).tolist():
                own = b.filter(pa.array(sizes == n))
                p = pivots.get(n, np.empty((0, n)))
                d = distances(matrix(own.column("v")), p)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("v"), lists], names=["vec_id", "v", "d"])

    tabled = lambda df: df.mapInArrow(table, "vec_id long, v array<bigint>, d array<double>").withColumn("n", F.size("v"))
    candidates = tabled(data).withColumn("db", blocks("vec_id", n_blocks, spread=True)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))).withColumn("asks", F.lit(False))
    asking = tabled(asked).withColumn("qb", blocks("vec_id", n_query_blocks)).withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("asks", F.lit(True))

    def search(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy(zero_copy_only=False)
        ids, v, d = group["vec_id"].to_numpy(), matrix(group["v"], np.int64), matrix(group["d"])
        found = best_of_block(v[asks], d[asks], ids[asks], v[~asks], d[~asks], ids[~asks], k)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return best(candidates.unionByName(asking).groupBy("n", "qb", "db").applyInArrow(search, RESULT), k)


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, x.vec_id, max(list_dot_product(q.v, x.v))::bigint as score from v q join v x on q.vec_id % 50 = 0 and q.vec_id <> x.vec_id group by 1, 2),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""
