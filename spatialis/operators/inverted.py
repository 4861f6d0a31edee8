"""Approximate neighbours by inverted lists of product-quantised codes.

Coarse centroids, and for each part of the dimensions a codebook of residuals, are fitted on a bounded sample. Every
reference row goes to the list of its nearest centroid as a code of one byte a part. A query visits the lists of its
nearest centroids, as many as sampled queries need; there, distances are those to the codes, and the best candidates of
a group of lists are ranked by their true distances where they lie."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialis.sources.staging import staged

#: Sampled rows; most lists, rows a list is meant to hold; dimensions of a part; candidates for each neighbour;
#: share of sampled neighbours that the visited lists must hold; rows and queries of a task, queries at a time.
SAMPLE, LISTS, LIST_ROWS, PART, CANDIDATES, HELD, ROWS, QUERIES, STEP = 16_384, 1024, 256, 4, 12, 0.98, 32_768, 16_384, 64


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * (a @ b.T), 0)


def _closest(a: np.ndarray, b: np.ndarray, some: int = 4096) -> np.ndarray:
    return np.concatenate([_squared(a[i : i + some], b).argmin(axis=1) for i in range(0, len(a), some)]) if len(a) else np.empty(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids by Lloyd's rounds from k drawn rows; an empty one stays where it was."""
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _closest(x, centers)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


@dataclass
class Index:
    """Coarse centroids, a codebook for each part of the dimensions, and the number of lists to visit."""

    centers: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]
    visits: int

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, k: int, seed: int = 7) -> Index:
        """From sampled vectors of a table of so many rows."""
        rng = np.random.default_rng(seed)
        lists = max(1, min(LISTS, rows // LIST_ROWS, len(sample) // 8))
        centers = k_means(sample, lists, 8, rng)
        at = _closest(sample, centers)
        rest = sample - centers[at]
        cuts = list(range(0, sample.shape[1], PART)) + [sample.shape[1]]
        books = [k_means(rest[:, a:b], min(256, len(rest)), 6, rng) for a, b in zip(cuts, cuts[1:])]
        # How many lists sampled queries must visit to meet the neighbours they have in the sample.
        asked = rng.choice(len(sample), min(256, len(sample)), replace=False)
        near = np.argsort(_squared(sample[asked], sample), axis=1)[:, 1 : k + 1]
        order = np.argsort(np.argsort(_squared(sample[asked], centers), axis=1), axis=1)
        depth = np.take_along_axis(order, at[near], axis=1).ravel()
        visits = int(np.quantile(depth, HELD, method="higher")) + 1 if len(depth) else 1
        return cls(centers, books, cuts, visits)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each row."""
        at = _closest(x, self.centers)
        rest = x - self.centers[at]
        codes = [_closest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]
        return at, np.column_stack(codes).astype(np.uint8) if len(x) else np.empty((0, len(self.books)), np.uint8)

    def decode(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that lists and codes stand for."""
        return self.centers[at] + np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def approximate_neighbours(ref: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, label, rank, dist): about the k nearest reference rows of each query, by Euclidean
    distance, ties to the smaller id. Rows without a vector take no part. Lists are searched in groups; one of more than twice
    ROWS rows, or that more than QUERIES queries visit, is dealt over several tasks."""
    vector = F.col("embedding").cast("array<double>").alias("e")
    rows = staged(ref.where("embedding is not null").select("vec_id", "label", vector), "reference")
    asked = query.where("embedding is not null").select(F.col("vec_id").alias("query_id"), vector)
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(SAMPLE).select("e").toArrow()["e"]
    if not len(sample):
        return rows.select(F.lit(None).cast("long").alias("query_id"), "vec_id", "label", F.lit(1).alias("rank"), F.lit(0.0).alias("dist")).where("false")
    index = Index.fit(_matrix(sample), rows.count(), k)
    width, wanted = len(index.books), max(100, CANDIDATES * k)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, codes = index.encode(_matrix(b.column("e")) if b.num_rows else np.empty((0, index.cuts[-1])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=[*b.schema.names, "list", "code"])

    label = rows.schema["label"].dataType.simpleString()
    codes = staged(rows.mapInArrow(encode, f"vec_id long, label {label}, e array<double>, list int, code binary"), "codes")
    counts = lambda df, by: dict(map(tuple, df.groupBy(by).count().collect()))  # noqa: E731  # at most LISTS rows
    held = counts(codes, "list")
    filled = np.array(sorted(held))
    # Whichever lists a query visits, they hold k rows.
    visits = min(len(filled), max(index.visits, int(np.searchsorted(np.cumsum(sorted(held.values())), min(k, sum(held.values())))) + 1))
    # Lists lie together in groups of about ROWS rows, in which a query has one row and leaves k.
    group_of = np.zeros(int(filled[-1]) + 1, np.int32)
    group_of[filled] = (np.cumsum([held[i] for i in filled.tolist()]) - 1) // ROWS

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                gap = _squared(_matrix(b.column("e")), index.centers[filled])
                lists = filled[np.argsort(gap, axis=1, kind="stable")[:, :visits]]
                lists = np.sort(lists, axis=1)  # groups are ranges of lists
                begin = np.diff(group_of[lists], axis=1, prepend=-1) != 0
                own = pa.array(np.nonzero(begin)[0])
                ends = [*np.flatnonzero(begin.ravel()), lists.size]
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(own), b.column("e").take(own), pa.array(group_of[lists[begin]], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lists.ravel(), pa.int32()))], names=["query_id", "e", "group", "lists"])

    visited = staged(asked.mapInArrow(visit, "query_id long, e array<double>, group int, lists array<int>"), "visits")
    parts = lambda known, n: {i: -(-c // n) for i, c in known.items()}
    sizes: dict[int, int] = {}
    for i, n in held.items():
        sizes[int(group_of[i])] = sizes.get(int(group_of[i]), 0) + n
    of_rows, of_queries = parts(sizes, 2 * ROWS), parts(counts(visited, "group"), QUERIES)
    number = lambda known: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("group")), F.lit(1)) if known else F.lit(1)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    n_rows: Column = number(of_rows)
    n_queries: Column = number(of_queries)
    group = F.element_at(F.array(*[F.lit(int(g)) for g in group_of]), F.col("list") + 1)
    left = codes.withColumn("group", group).withColumn("rp", dealt("vec_id", n_rows)).withColumn("qp", every(n_queries))
    right = visited.withColumn("qp", dealt("query_id", n_queries)).withColumn("rp", every(n_rows))

    def search(there: pa.Table, asking: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)])
        if there.num_rows and asking.num_rows:
            at, ids, x = there["list"].to_numpy(), there["vec_id"].to_numpy(), _matrix(there["e"])
            code = np.frombuffer(b"".join(there["code"].to_pylist()), np.uint8).reshape(len(ids), width)
            # A distance to a row's code is that to its centroid and its codebooks' entries put together.
            made = index.decode(at, code)
            asks, lists = _matrix(asking["e"]), asking["lists"].to_pylist()
            order = sorted(range(len(lists)), key=lambda i: lists[i])
            for i in range(0, len(order), STEP):
                some = order[i : i + STEP]
                sees = np.zeros((len(some), len(group_of)), bool)
                for j, q in enumerate(some):
                    sees[j, lists[q]] = True
                near = np.flatnonzero(sees.any(axis=0)[at])
                if not len(near):
                    continue
                about = np.where(sees[:, at[near]], _squared(asks[some], made[near]), np.inf)
                most = np.partition(about, wanted - 1, axis=1)[:, wanted - 1] if len(near) > wanted else np.full(len(some), np.inf)
                # Equal codes are equal but for the last digits of products; of them the smaller ids come first.
                row, column = np.nonzero((about <= (most + 1e-9 * (1 + most))[:, None]) & (about < np.inf))
                by = np.lexsort((ids[near[column]], np.round(about[row, column], 9), row))
                by = by[np.arange(len(by)) - np.searchsorted(row, row[by]) < wanted]
                row, column = row[by], near[column[by]]
                dist = np.sqrt(((x[column] - asks[some][row]) ** 2).sum(axis=1))
                by = np.lexsort((ids[column], np.round(dist, 9), row))
                by = by[np.arange(len(by)) - np.searchsorted(row[by], row[by]) < k]
                out[0].append(np.array(some)[row[by]])
                out[1].append(column[by])
                out[2].append(dist[by])
        own, row, dist = map(np.concatenate, out)
        if not len(own):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "label": pa.array([], there["label"].type if there.num_rows else pa.int32()), "dist": pa.array([], pa.float64())})
        return pa.table({"query_id": asking["query_id"].take(pa.array(own)), "vec_id": there["vec_id"].take(pa.array(row)), "label": there["label"].take(pa.array(row)), "dist": pa.array(dist)})

    found = left.groupBy("group", "rp", "qp").cogroup(right.groupBy("group", "rp", "qp")).applyInArrow(search, f"query_id long, vec_id long, label {label}, dist double")
    exact = found.withColumn("dist", F.round("dist", 9))
    first = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return exact.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "vec_id", "label", "rank", "dist")
