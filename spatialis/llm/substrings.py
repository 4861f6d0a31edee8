"""Removal of repeated passages by difference-cover anchors.

A passage repeats if WINDOW consecutive words of one document also start anywhere else. Words are hashed
at cover positions only: place p of a document carries an anchor, the hash of the ANCHOR words from p on,
if p modulo PERIOD is in COVER. COVER is a difference cover: every difference modulo PERIOD is one of two
of its members. So for any two equal windows there is a shift below PERIOD at which both carry an anchor,
and as ANCHOR = WINDOW - PERIOD + 1, that anchor lies within the windows: equal windows share it.

An anchor found twice is extended: all windows around it are hashed in full, and a window whose hash is
found twice repeats. Both searches are dealt by hash into buckets. Before that, each chunk of documents
settles what it can by itself (hashes it holds twice) and sends one row for each hash, so a passage that
a third of all documents hold reaches its bucket once for each chunk. Buckets of windows follow the
smallest of the window's 5-word hashes, so that neighbouring windows travel together as runs.

Null texts have no words. Windows are judged on the input; texts are taken whole; copies and repeated rows
count as places of their own, so all windows of a repeated row repeat. Texts shorter than a window are
kept. Columns n_words, n_removed and kept are replaced, all others pass through unchanged. An empty table
gives an empty result. Hashes have 64 bits; a collision can only matter
between windows that share an anchor with some other window and fall into the same bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatialis.llm.common import free_name, partitions, staged, text_chunks
from spatialis.llm.words import hash_words, mix, window_hashes, words_of

WINDOW, PERIOD = 35, 21
#: A perfect difference set: 5 * 4 differences are 1 to 20, once each.
COVER = (3, 6, 7, 12, 14)
ANCHOR = WINDOW - PERIOD + 1
CHUNK_CHARS, SEED_WORDS, LEAST_BUCKETS = 2_000_000, 5, 1024
#: Stands for a place that needs no answer, as its chunk knows already that the hash is there twice.
_KNOWN = np.uint32(0xFFFFFFFF)
PACKED = "bucket int, hashes binary, nodes binary, starts binary, sizes binary"
RUNS = "node long, start int, size int"


def _runs(nodes: np.ndarray, places: np.ndarray, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive places begin, and their lengths."""
    if not len(places):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = (nodes[1:] != nodes[:-1]) | (places[1:] != places[:-1] + 1)
    if groups is not None:
        new |= groups[1:] != groups[:-1]
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    return first, np.diff(np.concatenate([first, [len(places)]]))


def pack(hashes: np.ndarray, nodes: np.ndarray, places: np.ndarray, buckets: np.ndarray, chunk_bucket: int) -> pd.DataFrame:
    """Rows of PACKED for the places of one chunk: a row for each bucket, and one without hashes for the
    places whose hash the chunk holds twice."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(hashes), bool)
    twice[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    first = np.zeros(len(hashes), bool)
    first[order] = ~np.concatenate([[False], same]) if len(hashes) else same
    send = np.flatnonzero(~twice | first)
    send = send[np.lexsort((twice[send], buckets[send]))]  # stable: by document and place within a bucket
    h, n, p, b = hashes[send], nodes[send].copy(), places[send].astype(np.int64), buckets[send]
    silent = twice[send]
    n[silent], p[silent] = 0, int(_KNOWN)
    at, size = _runs(n, np.where(silent, -2 * np.arange(len(p)), p), b)
    rows = []
    edges = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]]) if len(b) else np.zeros(1, np.int64)
    run_edges = np.searchsorted(at, edges)
    n, p, size = n[at], p[at].astype(np.uint32), size.astype(np.uint32)
    for i, j, x, y in zip(edges[:-1], edges[1:], run_edges[:-1], run_edges[1:]):
        rows.append((int(b[i]), h[i:j].tobytes(), n[x:y].tobytes(), p[x:y].tobytes(), size[x:y].tobytes()))
    own = np.flatnonzero(twice)
    if len(own):
        at, size = _runs(nodes[own], places[own])
        rows.append((chunk_bucket, None, nodes[own][at].tobytes(), places[own][at].astype(np.uint32).tobytes(), size.astype(np.uint32).tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "hashes", "nodes", "starts", "sizes"])


def find_twice(group: pa.Table) -> pa.Table:
    """The places, as runs, whose hash a bucket holds twice."""
    nodes, starts, sizes, hashes, open_rows = [], [], [], [], []
    for h, n, s, z in zip(*(group[c].to_pylist() for c in ("hashes", "nodes", "starts", "sizes"))):
        n, s, z = np.frombuffer(n, np.int64), np.frombuffer(s, np.uint32), np.frombuffer(z, np.uint32)
        if h is None:
            nodes.append(n), starts.append(s.astype(np.int64)), sizes.append(z.astype(np.int64))
        else:
            hashes.append(np.frombuffer(h, np.uint64))
            open_rows.append((n, s, z))
    if hashes:
        h = np.concatenate(hashes)
        n, s, z = (np.concatenate([r[i] for r in open_rows]) for i in range(3))
        z = z.astype(np.int64)
        node = np.repeat(n, z)
        known = np.repeat(s == _KNOWN, z)
        place = np.repeat(s.astype(np.int64), z) + np.arange(len(h)) - np.repeat(np.cumsum(z) - z, z)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        twice &= ~known
        node, place = node[twice], place[twice]
        order = np.lexsort((place, node))
        node, place = node[order], place[order]
        # Repeated rows are one node: a place counts once.
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (place[1:] != place[:-1])
        node, place = node[new], place[new]
        at, size = _runs(node, place)
        nodes.append(node[at]), starts.append(place[at]), sizes.append(size)
    return pa.table(
        [pa.array(np.concatenate([*nodes, np.empty(0, np.int64)])), pa.array(np.concatenate([*starts, np.empty(0, np.int64)]).astype(np.int32)), pa.array(np.concatenate([*sizes, np.empty(0, np.int64)]).astype(np.int32))],
        names=["node", "start", "size"],
    )


def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order, about CHUNK_CHARS of text at a time."""
    for b in batches:
        at, size = 0, 0
        for i, t in enumerate(b["text"]):
            size += len(t or "")
            if size >= CHUNK_CHARS:
                yield b.iloc[at : i + 1]
                at, size = i + 1, 0
        if at < len(b):
            yield b.iloc[at:]


def _places(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of a chunk: its hash, its document's number, its place and its document's length."""
    words = [words_of(t, lower=False) for t in b["text"]]
    n = np.array([len(w) for w in words], np.int64)
    h = hash_words(words)
    doc = np.repeat(np.arange(len(n)), n)
    return h, doc, np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n), np.repeat(n, n)


def _anchors(buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in chunked(batches):
            h, doc, place, n = _places(b)
            own = np.flatnonzero(cover[place % PERIOD] & (place + ANCHOR <= n) & (n >= WINDOW))
            if not len(own):
                continue
            hashes = window_hashes(h, [ANCHOR])[ANCHOR][own]
            nodes = b["node"].to_numpy()[doc[own]]
            yield pack(hashes, nodes, place[own], (hashes % np.uint64(buckets)).astype(np.int64), int(nodes[0] % buckets))

    return run


def _windows(buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in chunked(batches):
            h, doc, place, n = _places(b)
            near = np.zeros(len(h) + 1, np.int64)
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(b)))])
            for i, runs in enumerate(b["runs"]):
                for start, size in ((r["start"], r["size"]) for r in runs):
                    if at[i] + start + size <= at[i + 1]:
                        near[at[i] + max(0, start - PERIOD + 1)] += 1
                        near[at[i] + start + size] -= 1
            own = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (place + WINDOW <= n))
            if not len(own):
                continue
            hashed = window_hashes(h, [WINDOW, SEED_WORDS])
            least, span, reach = hashed[SEED_WORDS], 1, WINDOW - SEED_WORDS + 1
            pad = lambda a, k: np.concatenate([a[k:], np.full(min(k, len(a)), np.iinfo(np.uint64).max, np.uint64)])
            while 2 * span <= reach:
                least = np.minimum(least, pad(least, span))
                span *= 2
            least = np.minimum(least, pad(least, reach - span))
            to = (mix(least[own], np.full(len(own), 7, np.uint64)) % np.uint64(buckets)).astype(np.int64)
            nodes = b["node"].to_numpy()[doc[own]]
            yield pack(hashed[WINDOW][own], nodes, place[own], to, int(nodes[0] % buckets))

    return run


def _listed(runs: DataFrame) -> DataFrame:
    """The distinct runs of each node; repeated rows, which are one node, bring the same runs."""
    return runs.distinct().groupBy("node").agg(F.collect_list(F.struct("start", "size")).alias("runs"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """Runs (node, start, size) of places at which a repeated window starts, from docs (node, text)."""
    buckets = max(LEAST_BUCKETS, partitions(docs.sparkSession, 16))
    own = docs.select("node", "text")
    anchors = own.mapInPandas(_anchors(buckets), PACKED).groupBy("bucket").applyInArrow(find_twice, RUNS)
    near = staged(_listed(anchors), "anchors")
    return own.join(near, "node").mapInPandas(_windows(buckets), PACKED).groupBy("bucket").applyInArrow(find_twice, RUNS)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text and others) with n_words, n_removed and kept: the words outside repeated
    windows, joined by one space."""
    node, runs = (free_name(docs, x) for x in ("node", "runs"))
    docs = docs.drop("n_words", "n_removed", "kept")
    keyed = docs.withColumn(node, F.xxhash64("doc_id", "text"))
    found = staged(_listed(repeated_windows(keyed.select(F.col(node).alias("node"), "text"))), "repeats")
    joined = keyed.join(found.select(F.col("node").alias(node), F.col("runs").alias(runs)), node, "left").select(*docs.columns, runs)
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_chunks(batches, CHUNK_CHARS):
            rows = []
            for text, own in zip(texts, b.column(b.num_columns - 1).to_pylist()):
                words = words_of(text, lower=False)
                edge = np.zeros(len(words) + 1, np.int64)
                for start, size in ((r["start"], r["size"]) for r in own or []):
                    if start + size - 1 + WINDOW <= len(words):
                        edge[start] += 1
                        edge[start + size - 1 + WINDOW] -= 1
                covered = np.cumsum(edge[:-1]) > 0
                kept = [w for w, gone in zip(words, covered) if not gone] if covered.any() else words
                rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            out = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], names=[*b.schema.names[:-1], *(f.name for f in added)])

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
