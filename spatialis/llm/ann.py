"""Approximate nearest neighbours by learned partitions.

On a sample of at most SAMPLE rows: the graph of nearest neighbours is cut into parts of equal size
(halving along principal directions, then moving rows to the part that holds most of their neighbours
while sizes stay balanced), and a small softmax classifier learns which parts hold a vector's
neighbours. Every row is then indexed under its most probable part. A query goes to its most probable
parts, as many as reached the recall TARGET on sampled queries, and all rows of those parts are ranked
by exact inner products.

Parts larger than a block are dealt into blocks by id, and queries visit all blocks of a part: no part
is capped and none is one task. Recall is measured in tests against brute force.

Rows with a null id, or a vector that is null, empty, zero or has null or non-finite components, take
no part. Vectors of another length than most of the sample's take no part either. A query finds no rows
of its own id. Rows that share an id are one to a search: it is found once, at its highest score, and asks
with each of its vectors. Equal scores are ordered by id. A sample of under four rows for each part can't
be cut: all rows are then one part, and the search is exact. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialis.llm.vectors import best, blocks, matrix, usable

SAMPLE, NEIGHBOURS, TARGET = 4096, 10, 0.96
#: Rows a part should hold, the range of the number of parts, and rows in a block.
PART_ROWS, LEAST_PARTS, MOST_PARTS, BLOCK, QUERY_BLOCK = 4096, 16, 128, 32_768, 32_768
RESULT = "query_id long, vec_id long, score double"


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest others by inner product."""
    out = []
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out.append(np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 6) -> np.ndarray:
    """A part for each row; parts differ little in size and cut few edges of the graph."""
    part = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        own = groups.pop(int(np.argmax([len(g) for g in groups])))
        centred = x[own] - x[own].mean(axis=0)
        side = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = np.argsort(side, kind="stable")
        groups += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    for i, g in enumerate(groups):
        part[g] = i
    most = int(np.ceil(1.1 * len(x) / parts))
    least = int(0.9 * len(x) / parts)
    edges = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])], axis=1)
    size = np.bincount(part, minlength=parts)
    for _ in range(sweeps):
        votes = np.bincount(edges[0] * parts + part[edges[1]], minlength=len(x) * parts).reshape(len(x), parts)
        gain = votes.max(axis=1) - votes[np.arange(len(x)), part]
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            to = votes[i].argmax()
            if size[to] < most and size[part[i]] > least:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
    return part


@dataclass
class Router:
    """A softmax classifier over parts."""

    weights: np.ndarray
    bias: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.weights + self.bias


def fit_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, rounds: int = 150) -> Router:
    """Learns the share of a row's neighbours, itself included, that each part holds."""
    target = np.bincount(np.repeat(np.arange(len(x)), graph.shape[1]) * parts + part[graph.ravel()], minlength=len(x) * parts).reshape(len(x), parts).astype(float)
    target[np.arange(len(x)), part] += graph.shape[1] / 2 + 1
    target /= target.sum(axis=1, keepdims=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    own = Router(np.zeros((x.shape[1], parts)), np.zeros(parts))
    m = [np.zeros_like(own.weights), np.zeros(parts)]
    v = [np.zeros_like(own.weights), np.zeros(parts)]
    for i in range(1, rounds + 1):
        z = unit @ own.weights + own.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - target) / len(x)
        for j, (value, slope) in enumerate(((own.weights, unit.T @ g + 1e-5 * own.weights), (own.bias, g.sum(axis=0)))):
            m[j] = 0.9 * m[j] + 0.1 * slope
            v[j] = 0.99 * v[j] + 0.01 * slope**2
            value -= 0.2 * (m[j] / (1 - 0.9**i)) / (np.sqrt(v[j] / (1 - 0.99**i)) + 1e-9)
    return own


def probes_for(x: np.ndarray, router: Router, k: int, target: float, asked: int = 512) -> int:
    """How many parts a query visits for its k nearest of the sample to be found with `target` recall."""
    z = router.logits(x)
    home = z.argmax(axis=1)
    order = np.argsort(-z[:asked], axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(z.shape[1]), order.shape), axis=1)
    s = x[:asked] @ x.T
    s[np.arange(len(s)), np.arange(len(s))] = -np.inf
    near = np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1 if len(needed) else 1


@dataclass
class Index:
    """What is learned of the sample: of a fixed size, whatever the data's."""

    router: Router
    dim: int
    parts: int
    probes: int


def fit_index(data: DataFrame, n_rows: int, k: int, sample: int = SAMPLE, target: float = TARGET) -> Index | None:
    rows = data.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).toArrow()["v"].to_pylist()
    if not rows:
        return None
    dim = int(np.bincount([len(v) for v in rows]).argmax())
    x = np.array([v for v in rows if len(v) == dim])
    parts = int(min(MOST_PARTS, max(LEAST_PARTS, n_rows // PART_ROWS)))
    if len(x) < 4 * parts:
        return Index(Router(np.zeros((dim, 1)), np.zeros(1)), dim, 1, 1)
    graph = neighbour_graph(x, NEIGHBOURS)
    router = fit_router(x, graph, balanced_parts(x, graph, parts), parts)
    return Index(router, dim, parts, probes_for(x, router, k, target))


def rerank(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[list, list, list]:
    """Each query's k nearest rows of a block. The matrix product only preselects, as its rounding
    depends on a row's place; scores are summed row by row in one order."""
    out: tuple[list, list, list] = ([], [], [])
    held = k + len(x_id) - len(np.unique(x_id))  # rows that surely hold k ids
    for at in range(0, len(q), 256):
        rough = q[at : at + 256] @ x.T
        for i, s in enumerate(rough, at):
            s[x_id == q_id[i]] = -np.inf
            there = np.flatnonzero(s > -np.inf)
            if len(there) > held:
                least = np.partition(s, len(s) - held)[len(s) - held]
                there = np.flatnonzero((s >= least - 1e-9 * (1 + abs(least))) & (s > -np.inf))
            exact = (x[there] * q[i]).sum(axis=1)
            top = np.lexsort((x_id[there], -exact))
            top = top[np.sort(np.unique(x_id[there[top]], return_index=True)[1])[:k]]
            out[0].extend([int(q_id[i])] * len(top))
            out[1].extend(x_id[there[top]].tolist())
            out[2].extend(exact[top].tolist())
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of `queries`."""
    spark = vectors.sparkSession
    data = usable(vectors, vec_id, embedding, zero=False)
    n_rows = data.count()
    index = fit_index(data, n_rows, k, sample, target)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)
    asked = usable(queries, vec_id, embedding, zero=False).distinct()
    n_queries = asked.count()
    n_query_blocks = max(1, -(-n_queries // QUERY_BLOCK))

    def routed(probes: int):
        def run(batches):
            own = shared.value
            for b in batches:
                order = np.argsort(-own.router.logits(matrix(b.column("v"))), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(order.tolist(), pa.list_(pa.int32()))], names=["vec_id", "v", "parts"])

        return run

    schema = "vec_id long, v array<double>, parts array<int>"
    same = F.size("v") == index.dim
    # The number of blocks of a part; a row for each part, which are at most MOST_PARTS.
    indexed = data.where(same).mapInArrow(routed(1), schema).withColumn("part", F.col("parts")[0]).drop("parts")
    sizes = {r["part"]: -(-r["n"] // BLOCK) for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for i in range(index.parts) for x in (i, max(1, sizes.get(i, 1)))]), F.col("part"))
    rows = indexed.withColumn("block", blocks("vec_id", n_blocks, spread=True)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))).withColumn("asks", F.lit(False))
    asking = (
        asked.where(same)
        .mapInArrow(routed(index.probes), schema)
        .withColumn("part", F.explode("parts"))
        .drop("parts")
        .withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        .withColumn("qb", blocks("vec_id", n_query_blocks))
        .withColumn("asks", F.lit(True))
    )

    def search(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy(zero_copy_only=False)
        ids, v = group["vec_id"].to_numpy(), matrix(group["v"])
        found = rerank(v[asks], ids[asks], v[~asks], ids[~asks], k) if asks.any() and not asks.all() else ([], [], [])
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return best(rows.unionByName(asking, allowMissingColumns=True).groupBy("part", "block", "qb").applyInArrow(search, RESULT), k)
