"""MinHash near-duplicates with circulant signatures, banding and exact verification.

A document's set holds its distinct shingles of consecutive words. Coordinate k of its signature is the
least pi(sigma(s) - k) over the set's hashes s: two permutations of the 32-bit numbers give all
coordinates, the second shifted by k (C-MinHash). Documents that agree in a band of coordinates are
candidates. Candidate groups are verified on their full sets of shingles, and the links that hold make
up components.

How large groups are kept apart: equal sets are one class from the start. Candidates are tied to the
smallest document of their bucket (a star, never all pairs), and the stars' components are the groups. A
group of at most CHUNK classes and CHUNK_CHARS characters is verified in one piece. Larger groups are
mostly chained by common passages, so they are taken apart first by a filter that loses nothing: two sets
that share t of their union share one of their (1 - t) n + 1 rarest shingles, in the order of how many
documents of large groups hold a shingle. Documents that share such a shingle make up the new groups.
What is still large is dense. It is dealt into chunks by a hash, twice, each chunk along with the group's
hubs (those that share most rare shingles); that joins what is linked to a hub or densely. Each document
that is still outside its group's largest component is then verified against all documents of about its
size with which it shares a rare shingle. So each pair that shares a bucket is verified, already in one
component, or too far apart to be linked.

Results: one row for each input row. Null and empty texts have no shingles and are linked with nothing.
Copies have the same component. Rows of null id are nodes by their text; their component_id is the
smallest id reachable, or null if there is none; they are not `kept`, as no id is theirs. Rows that share
an id are one node, whatever their texts. Very long texts are taken whole. Only doc_id and text are read,
so other columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatialis.llm.common import free_name, partitions, staged, text_chunks
from spatialis.llm.components import connected_components
from spatialis.llm.words import hash_words, mix, window_hashes, words_of

BANDS, BAND_ROWS = 32, 4
CHUNK, CHUNK_CHARS = 256, 2_000_000
#: Hubs of a large group, one for each slice of its documents.
HUBS = 8
#: Nodes of null doc_id lie from here on.
NO_ID = 1 << 62
#: Characters of text that are sketched, and searched for rare shingles, at a time.
SKETCH_CHARS, KEY_CHARS = 400_000, 2_000_000
_U32 = np.uint32


def permuted(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers; x is overwritten."""
    x ^= x >> _U32(16)
    x *= _U32(a)
    x ^= x >> _U32(15)
    x *= _U32(b)
    x ^= x >> _U32(16)
    return x


def signatures(sets: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Signatures (sets x coordinates) of sets that lie one after another; none is empty."""
    first = permuted((sets ^ (sets >> np.uint64(32))).astype(_U32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((len(starts), coordinates), _U32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(permuted(first - _U32(k), 0x2C1B3C6D, 0x297A2D39), starts)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each set and band."""
    wide = sig.astype(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands))
    for r in range(rows):
        key = mix(key, wide[:, :, r])
    return key.view(np.int64)


def shingle_hashes(words: list[list[bytes]], size: int) -> list[np.ndarray]:
    """The distinct shingles of each document, hashed and sorted; fewer words are one shingle."""
    h = hash_words(words)
    whole = window_hashes(h, [size])[size]
    out, at = [], 0
    for w in words:
        n = len(w)
        if n >= size:
            out.append(np.unique(whole[at : at + n - size + 1]))
        elif n:
            own = np.array([n], np.uint64)
            for x in h[at : at + n]:
                own = mix(own, np.array([x], np.uint64))
            out.append(own)
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


SKETCH = "node long, doc_id long, n_shingles long, sa long, sb long, chars long, bands array<long>"


def node_of(doc_id: Column, text: Column) -> Column:
    """The node of a row: its id, or a number from NO_ID on that its text gives."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID) + F.xxhash64(text).bitwiseAND(F.lit((1 << 60) - 1)))


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """For each row: size of the set, 128 bits that stand for the set, and the keys of its bands."""

    def part(b: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        sets = shingle_hashes([words_of(t, lower=True) for t in texts], size)
        n = np.array([len(s) for s in sets], np.int64)
        some = np.flatnonzero(n)
        keys: list = [None] * len(sets)
        sa, sb = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        if len(some):
            every = np.concatenate([sets[i] for i in some])
            starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            # A sum of hashes doesn't depend on the order; two sums make 128 bits.
            sa[some] = np.add.reduceat(mix(every, np.full_like(every, 1)), starts).view(np.int64)
            sb[some] = np.add.reduceat(mix(every, np.full_like(every, 2)), starts).view(np.int64)
            for i, k in zip(some, band_keys(signatures(every, starts, bands * rows), bands, rows)):
                keys[i] = k
        columns = [b.column("node"), b.column("doc_id"), pa.array(n), pa.array(sa), pa.array(sb), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["node", "doc_id", "n_shingles", "sa", "sb", "chars", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_chunks(batches, SKETCH_CHARS):
            yield part(b, texts)

    return docs.select(node_of(F.col("doc_id"), F.col("text")).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def shared_sizes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the texts' sets of shingles, and of the intersections of all pairs; shingles are
    compared as they are, not by hashes."""
    ids: dict[bytes, int] = {}
    sets = []
    for t in texts:
        w = words_of(t, lower=True)
        own = {b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {b" ".join(w)} if w else set()
        sets.append(np.fromiter((ids.setdefault(s, len(ids)) for s in own), np.int64, len(own)))
    inter = np.zeros((len(sets), len(sets)))
    row, col = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([*sets, np.empty(0, np.int64)])
    # A shingle of a single document adds to no pair.
    often = np.bincount(col, minlength=1) > 1
    row, col = row[often[col]], (np.cumsum(often) - 1)[col[often[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(often.sum()), 16_384):
        i, j = np.searchsorted(col, [at, at + 16_384])
        block = np.zeros((len(sets), 16_384), np.float32)
        block[row[i:j], col[i:j] - at] = 1
        inter += block @ block.T
    return np.array([len(s) for s in sets]), inter


def linked_pairs(texts: list[str], size: int, percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for all pairs of texts with words."""
    n, inter = shared_sizes(texts, size)
    return (100 * inter >= percent * (n[:, None] + n[None] - inter)) & (inter > 0)


def _spanning(links: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, smallest node found with it) that connect what `links` connects."""
    root = np.arange(len(nodes))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in np.argwhere(np.triu(links, 1)):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _verify(rows: DataFrame, keys: list[str], size: int, percent: int) -> DataFrame:
    """Links (a, b) within each group of `rows`(node, text)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node", kind="stable").drop_duplicates(["node", "text"])
        links = linked_pairs(list(g["text"]), size, percent)
        return pd.DataFrame(_spanning(links, g["node"].to_numpy()), columns=["a", "b"], dtype="int64")

    return rows.select(*keys, "node", "text").groupBy(*keys).applyInPandas(run, "a long, b long")


def _chunk(round_no: int, chunks: str = "chunks") -> Column:
    return F.pmod(F.xxhash64(F.lit(round_no), "unit"), F.col(chunks)).cast("int")


def _stars(entries: DataFrame, node: str, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """What ties the nodes of each key to the smallest of them: edges (a, b), and (key, lead, n)."""
    leads = staged(entries.groupBy(key).agg(F.min(node).alias("lead"), F.max(node).alias("last"), F.count(F.lit(1)).alias("n")).where("lead <> last").select(key, "lead", "n"), "leads")
    return entries.join(leads, key).where(F.col(node) != F.col("lead")).select(F.col(node).alias("a"), F.col("lead").alias("b")).distinct(), leads


def _chunks_of(rows: DataFrame) -> DataFrame:
    """(root, chunks) of rows (root, chars), one for each unit."""
    return rows.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("chars") / CHUNK_CHARS)).cast("int").alias("chunks"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay: of each component the document of the smallest id, once. Components
    without any id keep the smallest node, once. Columns of any name pass through."""
    node, text = (free_name(docs, x) for x in ("node", "text_hash"))
    own = docs.withColumns({node: node_of(F.col("doc_id"), F.col("text")), text: F.xxhash64("text")})
    stay = staged(_components(docs.select("doc_id", "text"), size, percent).where("node = component").select(F.col("node").alias(node)).distinct(), "stay")
    return own.join(stay, node, "left_semi").dropDuplicates([node, text]).select(docs.columns)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """node, doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text): documents whose
    sets share `percent` of their union are linked; component_id is the smallest doc_id reachable."""
    own = _components(docs, size, percent, bands, band_rows)
    named = F.when(F.col("component") < NO_ID, F.col("component"))
    return own.select("node", "doc_id", "n_shingles", named.alias("component_id"), F.coalesce(F.col("doc_id") == named, F.lit(False)).alias("kept"))


def _components(docs: DataFrame, size: int, percent: int, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """node, doc_id, n_shingles and component, the smallest node reachable, of each row."""
    sketch = staged(sketches(docs, size, bands, band_rows), "sketches")
    some = sketch.where("n_shingles > 0")
    # A class for each distinct set; its node is the smallest of its rows.
    classes = staged(some.groupBy("sa", "sb").agg(F.min("node").alias("node"), F.max("chars").alias("chars"), F.count(F.lit(1)).alias("n")), "classes")
    head = classes.select("node", "sa", "sb")
    entries = staged(some.join(head, ["node", "sa", "sb"]).dropDuplicates(["node", "sa", "sb"]).select("node", F.explode("bands").alias("key")), "entries")
    stars, _ = _stars(entries, "node")
    groups = staged(connected_components(stars).select("node", F.col("component").alias("root")), "groups")
    sizes = staged(_chunks_of(groups.join(classes.groupBy("node").agg(F.max("chars").alias("chars")), "node")), "sizes")
    # Only the texts of candidates travel on, each once: a unit is a node and one of its texts.
    texts = docs.select(node_of(F.col("doc_id"), F.col("text")).alias("node"), F.xxhash64("text").alias("th"), "text")
    member = groups.join(sizes, "root")
    rows = texts.join(member, "node").dropDuplicates(["node", "th"]).withColumns({"unit": F.xxhash64("node", "th"), "chars": F.length("text")})
    rows = staged(rows.select("unit", "node", "root", "chunks", "chars", "text"), "texts")
    links = [staged(_verify(rows.where("chunks = 1"), ["root"], size, percent), "links")]
    if not sizes.where("chunks > 1").isEmpty():
        links += _large_groups(rows.where("chunks > 1").select("unit", "node", "chars", "text"), size, percent)
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    found = staged(connected_components(every), "components")
    named = staged(classes.select("sa", "sb", "node").join(found, "node", "left").select("sa", "sb", F.coalesce("component", "node").alias("component")), "named")
    return (
        some.select("node", "doc_id", "n_shingles", "sa", "sb")
        .join(named, ["sa", "sb"])
        .select("node", "doc_id", "n_shingles", "component")
        .unionByName(sketch.where("n_shingles = 0").select("node", "doc_id", "n_shingles", F.col("node").alias("component")))
    )


KEYS = "unit long, n int, most int, key long"
PACKED = "chunk long, bucket int, hashes binary, counts binary, units binary, sizes binary"


def _packed(size: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of PACKED for each chunk of documents: one with its units and their shingles, and for each
    bucket one with the chunk's distinct shingles of that bucket and how many units hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_chunks(batches, KEY_CHARS):
            units = b.column("unit").to_numpy()
            sets = shingle_hashes([words_of(t, lower=True) for t in texts], size)
            every = np.concatenate([*sets, np.empty(0, np.uint64)])
            chunk = int(units.min())
            rows = [(chunk, None, every.tobytes(), None, units.tobytes(), np.array([len(s) for s in sets], np.int64).tobytes())]
            h, n = np.unique(every, return_counts=True)
            to = (mix(h, np.full_like(h, 3)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            h, n, to = h[order], n[order], to[order]
            edges = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
            for i, j in zip(edges, [*edges[1:], len(to)]):
                rows.append((chunk, int(to[i]), h[i:j].tobytes(), n[i:j].tobytes(), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64(), pa.int32(), *[pa.binary()] * 4])], names=["chunk", "bucket", "hashes", "counts", "units", "sizes"])

    return run


def _counted(group: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk those of its shingles that more than one unit holds, and how many do."""
    chunks, hashes, counts = group["chunk"].to_pylist(), group["hashes"].to_pylist(), group["counts"].to_pylist()
    parts = [np.frombuffer(h, np.uint64) for h in hashes]
    h, at = np.unique(np.concatenate(parts), return_inverse=True)
    n = np.bincount(at, np.concatenate([np.frombuffer(c, np.int64) for c in counts])).astype(np.int64)[at]
    rows, i = [], 0
    for chunk, own in zip(chunks, parts):
        c = n[i : i + len(own)]
        rows.append((chunk, own[c > 1].tobytes(), c[c > 1].tobytes()))
        i += len(own)
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64(), pa.binary(), pa.binary()])], names=["chunk", "hashes", "counts"])


def _rarest(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Rows of KEYS from what the buckets said of one chunk and the chunk's own row."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        told = [r for r in rows if r["units"] is None]
        h = np.concatenate([*(np.frombuffer(r["hashes"], np.uint64) for r in told), np.empty(0, np.uint64)])
        c = np.concatenate([*(np.frombuffer(r["counts"], np.int64) for r in told), np.empty(0, np.int64)])
        order = np.argsort(h)
        h, c = h[order], c[order]
        out: list[tuple] = []
        for r in (r for r in rows if r["units"] is not None):
            every, at = np.frombuffer(r["hashes"], np.uint64), 0
            for unit, n in zip(np.frombuffer(r["units"], np.int64).tolist(), np.frombuffer(r["sizes"], np.int64).tolist()):
                own = every[at : at + n]
                at += n
                i = np.minimum(np.searchsorted(h, own), max(0, len(h) - 1))
                held = h[i] == own if len(h) else np.zeros(n, bool)
                own, often = own[held], c[i[held]] if len(h) else c
                # Shingles that no other unit holds are the rarest, and come first without being listed.
                left = n - -(-percent * n // 100) + 1 - (n - len(own))
                if left > 0:
                    most = len(own) * (100 + percent) // percent - n
                    out.extend((unit, n, most, k) for k in own[np.lexsort((own, often))[:left]].view(np.int64).tolist())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, [pa.int64(), pa.int32(), pa.int32(), pa.int64()])], names=["unit", "n", "most", "key"])

    return run


def rare_keys(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(unit, n, most, key): of each of `rows` (unit, text) the shingles, hashed, by which a set can be
    linked: those of its (1 - percent) n + 1 rarest that another row holds too. n is the size of the set,
    most that of the largest set it can be linked with: of t (n + m) / (1 + t) shingles that the two
    must share, none is among those that no other row holds.

    Shingles are counted in two steps, so that a very common one reaches its bucket once for each chunk."""
    packed = staged(rows.select("unit", "text").mapInArrow(_packed(size, max(64, partitions(rows.sparkSession, 4))), PACKED), "packed")
    told = packed.where("bucket is not null").select("chunk", "bucket", "hashes", "counts").groupBy("bucket").applyInArrow(_counted, "chunk long, hashes binary, counts binary")
    own = packed.where("bucket is null").select("chunk", "hashes", "units", "sizes")
    return own.unionByName(told, allowMissingColumns=True).groupBy("chunk").applyInArrow(_rarest(percent), KEYS)


def _large_groups(large: DataFrame, size: int, percent: int) -> list[DataFrame]:
    """Links among the documents of groups that are too large to be verified in one piece."""
    keys = staged(rare_keys(large, size, percent), "keys")
    stars, leads = _stars(keys.select("unit", "key"), "unit")
    groups = staged(connected_components(stars).select(F.col("node").alias("unit"), F.col("component").alias("root")), "groups")
    rows = staged(large.join(groups, "unit"), "texts")
    sizes = staged(_chunks_of(rows), "sizes")
    rows = rows.join(sizes, "root")
    dense = sizes.where("chunks > 1")
    hubs = _hubs(keys, leads, groups.join(dense, "root")).join(rows.select("unit", "node", "text"), "unit")
    hubs = staged(hubs.select("root", "node", "text", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")), "hubs")
    links = []
    for i in range(1 if dense.isEmpty() else 2):
        own = rows.where(f"chunks > {i}").select("root", "node", "text", _chunk(i).alias("chunk"))
        links.append(staged(_verify(own.unionByName(hubs), ["root", "chunk"], size, percent), "links"))
    if len(links) > 1:
        links.append(staged(_verify(_stray_visits(rows.where("chunks > 1"), links[0].unionByName(links[1]), keys, percent), ["root", "chunk", "block"], size, percent), "links"))
    return links


def _hubs(keys: DataFrame, leads: DataFrame, member: DataFrame) -> DataFrame:
    """(root, chunks, unit): at most HUBS units of each group of `member` (root, chunks, unit)."""
    score = keys.select("unit", "key").join(leads, "key").groupBy("unit").agg(F.sum("n").alias("score"))
    part = F.pmod(F.xxhash64(F.lit(3), "unit"), F.lit(HUBS))
    return member.join(score, "unit").groupBy("root", part).agg(F.max(F.struct("score", "unit")).alias("m"), F.max("chunks").alias("chunks")).select("root", "chunks", F.col("m.unit").alias("unit"))


def _stray_visits(rows: DataFrame, links: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """root, chunk, block, node, text: each document outside its group's largest component, beside the
    chunks that hold a document of about its size with which it shares a key."""
    label = connected_components(links)
    labelled = staged(rows.select("unit", "node", "root", "chunks").join(label, "node", "left").select("unit", "root", "chunks", F.coalesce("component", "node").alias("component")), "labelled")
    counts = labelled.groupBy("root", "component").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("root").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("total"))
    main = staged(main.select("root", F.col("m.component").alias("main"), F.ceil((F.col("total") - F.col("m.n")) / CHUNK).cast("int").alias("blocks")), "main")
    block = F.pmod(F.xxhash64(F.lit(2), "unit"), F.col("blocks")).cast("int").alias("block")
    strays = staged(labelled.join(main, "root").where("component <> main").select("unit", "root", block), "strays")
    asked = keys.join(strays, "unit").select("key", "n", "most", "unit", "root", "block")
    # A list of places for each key: a stray meets a row for each of its own keys, not for each document.
    there = keys.join(labelled.select("unit", "chunks"), "unit").withColumn("chunk", _chunk(0))
    there = there.groupBy("key", "chunk").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("most").alias("most"))
    there = there.join(asked.select("key").distinct(), "key", "left_semi")
    places = staged(there.groupBy("key").agg(F.collect_list(F.struct("chunk", "least_n", "most_n", "most")).alias("there")), "places")
    # Of a place, some document has to be of a size that the stray can be linked with, and the other way.
    fits = lambda x: (x["least_n"] <= F.col("most")) & (x["most_n"] * 100 >= F.col("n") * percent) & (x["most"] >= F.col("n"))
    near = F.transform(F.filter("there", fits), lambda x: x["chunk"])
    own = asked.join(places, "key").groupBy("unit", "root", "block").agg(F.array_distinct(F.flatten(F.collect_list(near))).alias("there"))
    visits = staged(own.select("unit", "root", "block", F.explode("there").alias("chunk")), "visits")
    here = rows.withColumn("chunk", _chunk(0)).join(visits.select("root", "chunk", "block").distinct(), ["root", "chunk"]).select("root", "chunk", "block", "node", "text")
    return here.unionByName(rows.select("unit", "node", "text").join(visits, "unit").select("root", "chunk", "block", "node", "text"))
