"""Whitening of embeddings onto their leading principal components, by Chebyshev-filtered subspace iteration.

Components of a vector become integers, floor(scale * c). Their covariance V is never formed: a pass over
the table multiplies it with a block Q of a few columns, as the sum of y (y Q) over the centred rows y, a
d x block matrix whatever the number of rows. A step applies a Chebyshev polynomial of V to the block,
one pass for each degree: it stays small on the unwanted end of the spectrum and grows fast beyond. Then QR
and Rayleigh-Ritz turn the block towards the eigenvectors. Steps end when the residuals |V q - e q| of the
wanted pairs are as small as rounding lets them be, and a block whose spare columns were drawn anew finds
the same eigenvalues, so that no direction was missed.

Rows whose vector is null, empty or holds null or non-finite components take no part; vectors of the
commonest length do (of equally common ones the longest), others don't. Null ids stay null, repeated rows
count as often as they stand there. Directions without variance have no component, so a table of equal
vectors has none. Other columns are not read. An empty table gives an empty result. Components beyond what
a long holds are an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialis.llm.common import staged
from spatialis.llm.vectors import matrix

#: Spare columns of a block; highest degree of a polynomial; most steps; largest residual, against the first
#: eigenvalue, of a result; variance, against the first eigenvalue, that counts as none.
SPARE, DEGREE, STEPS, RESIDUAL, NONE = 8, 16, 200, 1e-10, 1e-11
#: Parts' sums are added up in so many groups before they come to the driver.
GROUPS = 64


@dataclass
class Whitening:
    """What was fitted: number of rows, sums of the integers, eigenvectors as columns, eigenvalues, trace of V."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def deviations(self, u: np.ndarray) -> np.ndarray:
        """n u - sums, exact."""
        if len(u) and max(abs(int(u.max())), abs(int(u.min()))) * self.n >= 1 << 62:
            raise OverflowError("components too large for exact deviations")
        return u * self.n - self.sums

    def project(self, u: np.ndarray) -> np.ndarray:
        return (self.deviations(u) / self.n) @ self.vectors / np.sqrt(self.values)


def integers(vectors: DataFrame, scale: float, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, u): the rows that take part, written once."""
    v = F.col("v")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where((F.size(v) > 0) & F.forall(v, fine))
    common = own.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("d")).limit(1).collect()
    rows = own.where(F.size(v) == (common[0]["d"] if common else 0))
    return staged(rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("u")), "integers")


def summed(data: DataFrame, part: Callable[[np.ndarray], np.ndarray], dtype: type = np.float64) -> np.ndarray | None:
    """The sum of part(u) over all rows (None: there are none). Each partition adds up its own; the sums come
    together in GROUPS groups, each in the order of partitions, and then on the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = None, 0
        for b in batches:
            if b.num_rows:
                number = b.column("part")[0].as_py()
                own = np.asarray(part(matrix(b.column("u"), np.int64)), dtype)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([number % GROUPS]), pa.array([number]), pa.array([total.tobytes()], pa.binary())], names=["bucket", "part", "sums"])

    def together(group: pa.Table) -> pa.Table:
        order = np.argsort(group["part"].to_numpy())
        values = group["sums"].to_pylist()
        total = np.zeros(len(values[0]) // 8, dtype)
        for i in order.tolist():
            total += np.frombuffer(values[i], dtype)
        return pa.table({"bucket": group["bucket"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    parts = data.select("u", F.spark_partition_id().cast("long").alias("part")).mapInArrow(partial, "bucket long, part long, sums binary")
    found = sorted(parts.groupBy("bucket").applyInArrow(together, "bucket long, sums binary").collect())
    return sum(np.frombuffer(r["sums"], dtype) for r in found) if found else None


def polynomial(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, high: float, first: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of V, at most 1 where eigenvalues lie between low and high, applied to q; scaled
    to be about 1 at the first eigenvalue."""
    centre, half = (low + high) / 2, (high - low) / 2
    start = s = half / (first - centre)
    before, y = q, (times(q) - centre * q) * (s / half)
    for _ in range(degree - 1):
        following = 1 / (2 / start - s)
        before, y, s = y, (times(y) - centre * y) * (2 * following / half) - (s * following) * before, following
    return y


def rayleigh_ritz(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Falling Ritz values of the block's span, their vectors and the norms of their residuals."""
    q = np.linalg.qr(q)[0]
    image = times(q)
    h = q.T @ image
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    return values, q @ turn, np.linalg.norm(image @ turn - (q @ turn) * values, axis=0)


def lowest(times: Callable[[np.ndarray], np.ndarray], d: int, steps: int, rng: np.random.Generator) -> float:
    """Where the spectrum begins, by a few steps of Lanczos, less the residual; at least 0."""
    q = np.zeros((d, 0))
    x = rng.normal(size=d)
    alpha, beta = [], []
    for _ in range(min(steps, d)):
        x = x / np.linalg.norm(x)
        q = np.column_stack([q, x])
        y = times(x[:, None])[:, 0]
        alpha.append(float(x @ y))
        y -= q @ (q.T @ y)
        y -= q @ (q.T @ y)
        beta.append(float(np.linalg.norm(y)))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)):
            break
        x = y
    values, turn = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return max(0.0, values[0] - beta[-1] * abs(turn[-1, 0]))


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues (fewer, if the rest has no variance) and eigenvectors of the symmetric,
    positive semidefinite matrix that `times` multiplies with."""
    rng = np.random.default_rng(seed)
    block = min(d, k + SPARE)
    values, q, residual = rayleigh_ritz(times, rng.normal(size=(d, block)))
    low = lowest(times, d, 8, rng) if block < d else 0.0
    last, anew = np.full(block, math.inf), None
    for _ in range(STEPS):
        wanted = min(k, int((values > NONE * values[0]).sum()))
        if values[0] <= 0 or not wanted:
            return np.empty(0), np.empty((d, 0))
        if block == d:
            break
        # Leading pairs as good as rounding lets them be stay as they are, and the filter works beside them.
        done = (residual <= RESIDUAL * values[0]) & (residual > last / 2)
        fixed = wanted if done[:wanted].all() else int(done.argmin())
        last = residual
        if fixed == wanted:
            if anew is not None and np.abs(values[:wanted] - anew[:wanted]).max() <= 1e-12 * values[0]:
                break
            # Once more with other spare columns.
            anew, q = values, np.column_stack([q[:, :wanted], rng.normal(size=(d, block - wanted))])
        high = max(values[-1], 1e-3 * values[fixed])
        low = min(low, high - 1e-7 * values[0])
        reach = lambda e: math.acosh(max(1.0, 1 + 2 * (e - high) / (high - low)))
        # The first columns may outgrow the last wanted one by so much that QR still tells them apart.
        spread = reach(values[fixed]) - reach(values[wanted - 1])
        degree = max(1, min(DEGREE, int(math.log(1e7) / spread) if spread > 0 else DEGREE))
        kept = q[:, :fixed]

        def beside(y: np.ndarray) -> np.ndarray:
            image = times(y)
            # What rounding leaves of the fixed pairs counts as inside the damped range.
            return image - kept @ (kept.T @ image - (low + high) / 2 * (kept.T @ y))

        rest = q[:, fixed:] - kept @ (kept.T @ q[:, fixed:])
        values, q, residual = rayleigh_ritz(times, np.column_stack([kept, polynomial(beside, rest, low, high, max(values[fixed], high), degree)]))
    else:
        raise ArithmeticError(f"no convergence after {STEPS} steps")
    return values[:wanted].copy(), q[:, :wanted].copy()


def fit_whitening(data: DataFrame, k: int) -> Whitening | None:
    """The whitening of (vec_id, u); None of an empty table."""
    counted = summed(data, lambda u: np.concatenate([[len(u)], u.sum(axis=0)]), np.int64)
    if counted is None:
        return None
    n, sums = int(counted[0]), counted[1:]
    d = len(sums)
    own = Whitening(n, sums, np.empty((d, 0)), np.empty(0), 0.0)
    centred = lambda u: own.deviations(u) / n

    def times(q: np.ndarray) -> np.ndarray:
        def part(u: np.ndarray) -> np.ndarray:
            y = centred(u)
            return (y.T @ (y @ q)).ravel()

        return summed(data, part).reshape(q.shape) / n

    trace = float(summed(data, lambda u: np.array([(centred(u) ** 2).sum()]))[0] / n)
    values, vectors = leading(times, d, min(k, d)) if trace > 0 else (np.empty(0), np.empty((d, 0)))
    return Whitening(n, sums, vectors, values, trace)


def identity_error(data: DataFrame, fit: Whitening) -> float:
    """The largest entry of |covariance of the whitened rows - identity|."""
    k = len(fit.values)
    mean = summed(data, lambda u: fit.project(u).sum(axis=0)) / fit.n

    def part(u: np.ndarray) -> np.ndarray:
        w = fit.project(u) - mean
        return (w.T @ w).ravel()

    return float(np.abs(summed(data, part).reshape(k, k) / fit.n - np.eye(k)).max())


ROWS = "vec_id long, deviation long, whitened array<double>"


def whitened(data: DataFrame, fit: Whitening) -> DataFrame:
    """vec_id, deviation (sum of (n u - sums)^2, exact) and whitened (a number for each component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = matrix(b.column("u"), np.int64)
            far = fit.deviations(u)
            exact = far if np.abs(far).max() < math.isqrt((1 << 63) // far.shape[1]) else far.astype(object)
            w = fit.project(u)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array((exact**2).sum(axis=1).tolist(), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return data.mapInArrow(run, ROWS)


def whiten(vectors: DataFrame, k: int = 32, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each vector and component, by falling variance: vec_id, component (from 1), n, deviation, whitened,
    explained (the component's share of all variance) and identity_error (see above)."""
    data = integers(vectors, scale, vec_id, embedding)
    fit = fit_whitening(data, k)
    if fit is None or not len(fit.values):
        fit = Whitening(1, np.zeros(1, np.int64), np.empty((1, 0)), np.empty(0), 1.0)
        data, error = data.where("false"), 0.0
    else:
        error = identity_error(data, fit)
    shares = F.array(*[F.lit(float(e / fit.trace)) for e in fit.values]).cast("array<double>")
    rows = whitened(data, fit).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
