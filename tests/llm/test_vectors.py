"""Vector search against brute force, awkward vectors included."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from spatialis.llm import ann, pivot_topk

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).round(3).tolist(), 1) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1], 1) for i in range(60)]  # copies: ties
    rows += [(400, None, 1), (401, [1.0, None] + [0.0] * 6, 1), (402, [NAN] * 8, 1), (403, [INF] + [0.0] * 7, 1), (404, [0.0] * 8, 1), (405, [], 1), (None, [1.0] * 8, 1), (7, rows[7][1], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def usable(df, zero):
    out = []
    for r in df.collect():
        v = r.embedding
        if r.vec_id is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out.append((r.vec_id, np.array(v, np.float64)))
    return out


def best(rows, every, k):
    """(query_id, rank, vec_id, score) with all candidates but the query's own id."""
    out = []
    for q, a in rows:
        scored = sorted(((-(float(a @ b) if a.dtype == float else int(a @ b)), i) for i, b in rows if i != q))[:k]
        if every(q):
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("block", [37, 16_384])
def test_pivot_search_is_exact(vectors, block):
    kept, pivot_topk.BLOCK = pivot_topk.BLOCK, block
    kept_q, pivot_topk.QUERY_BLOCK = pivot_topk.QUERY_BLOCK, 3 * block
    try:
        got = pivot_topk.pivot_top_k(vectors.dropDuplicates(["vec_id"]), vectors.dropDuplicates(["vec_id"]).where("vec_id % 50 = 0"), 5).collect()
        rows = [(i, np.floor(256 * v).astype(np.int64)) for i, v in dict(usable(vectors, True)).items()]
        assert sorted(map(tuple, got)) == sorted(best(rows, lambda q: q % 50 == 0, 5))
    finally:
        pivot_topk.BLOCK, pivot_topk.QUERY_BLOCK = kept, kept_q


def by_id(rows, wanted, k):
    """Each wanted id's k best other ids, an id at its highest score over all pairs of rows."""
    out = []
    for q in sorted({i for i, _ in rows if wanted(i)}):
        top = collections.defaultdict(lambda: -np.inf)
        for i, a in rows:
            for j, b in rows if i == q else ():
                if j != q:
                    top[j] = max(top[j], a @ b)
        out += [(q, n, j, -s) for n, (s, j) in enumerate(sorted((-s, j) for j, s in top.items())[:k], 1)]
    return out


@pytest.mark.parametrize("block", [16, 32_768])
def test_repeated_ids_are_one_to_a_search(spark, monkeypatch, block):
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.normal(size=8).round(3).tolist()) for i in rng.integers(0, 60, 200)]
    rows += rows[:40] + [(50, [3.0] * 8)] * 30
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for module in (pivot_topk, ann):
        monkeypatch.setattr(module, "BLOCK", block)
        monkeypatch.setattr(module, "QUERY_BLOCK", block)
    whole = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows]
    got = pivot_topk.pivot_top_k(docs, docs.where("vec_id % 10 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == sorted(by_id(whole, lambda i: i % 10 == 0, 5))
    # One part (a sample of three rows): exact.
    got = ann.nearest(docs, docs.where("vec_id % 10 = 0"), 5, sample=3).collect()
    want = by_id([(i, np.array(v)) for i, v in rows], lambda i: i % 10 == 0, 5)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(x[:3] for x in want)


def test_pivot_search_of_no_rows(vectors):
    assert pivot_topk.pivot_top_k(vectors.where("false"), vectors.where("false"), 5).count() == 0
    assert len(pivot_topk.pivot_top_k(vectors.where("vec_id < 3"), vectors.where("vec_id = 0"), 5).collect()) == 2


def test_bounds_eliminate():
    """On clustered vectors most candidates are never evaluated, as the bound stops the search."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(10, 16))[rng.integers(0, 10, 4000)] * 400 + rng.normal(size=(4000, 16)) * 3).astype(np.int64)
    pivots = pivot_topk.far_pivots(x.astype(float), 16)
    table = pivot_topk.distances(x.astype(float), pivots)
    found = pivot_topk.best_of_block(x[:5], table[:5], np.arange(5), x, table, np.arange(4000), 5)
    for q in range(5):
        s = x @ x[q]
        s[q] = -(1 << 62)
        want = sorted(zip(-s, range(4000)))[:5]
        assert [i for qq, i in zip(found[0], found[1]) if qq == q] == [i for _, i in want]


def test_nearest_recall_and_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()
    rows = usable(vectors, False)
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = collections.defaultdict(set)
    at = {i: n for n, i in enumerate(ids)}
    for r in got:
        found[r.query_id].add(r.vec_id)
        assert abs(r.score - x[at[r.query_id]] @ x[at[r.vec_id]]) < 1e-12
    hits = total = 0
    for i, v in rows:
        if i % 20 == 0:
            s = x @ v
            s[at[i]] = -np.inf
            want = set(ids[np.argsort(-s, kind="stable")[:20]])
            hits, total = hits + len(want & found[i]), total + 20
    assert hits / total >= 0.9
    assert all(len(v) == 20 for v in found.values())


def test_nearest_of_awkward_vectors(vectors):
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        by[r.query_id].append((-r.score, r.vec_id))
    assert set(by) == {i for i in range(0, 360, 20)}
    assert all(x == sorted(x) and q not in [i for _, i in x] for q, x in by.items())
    assert ann.nearest(vectors.where("false"), vectors.where("false"), 20).count() == 0
    assert len(ann.nearest(vectors.where("vec_id < 4"), vectors.where("vec_id = 0"), 20).collect()) == 3


def test_recall_beyond_the_sample(spark):
    """More rows than the sample that the parts are learned from."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12_000, 16))
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    got = collections.defaultdict(set)
    for r in ann.nearest(docs, docs.where("vec_id % 100 = 0"), 20, sample=2_000).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for i in range(0, len(x), 100):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & got[i])
    assert hits >= 0.9 * 20 * len(range(0, len(x), 100))
