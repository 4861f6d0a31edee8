"""Order-preserving packing of documents into sequences of bounded length, by dynamic programming.

The documents of a partition, in their order, are one stream of token ids, each document with `end_id`
behind it. The stream is cut into windows of at most `size` ids, one sequence each. Cuts may fall at the
end of a document (free), at the end of a sentence (SENTENCE) or, where a sentence is long and at the end
of the stream, inside one (INSIDE). A window costs its padding, SEQUENCE, and the price of the cut behind it;
padding is `size` less its length, or nothing if the length is a power of two. The cheapest cuts before
each place come by a monotone queue over (cost + place), which gives the best of the last `size` ids in
constant time, and by looking up the few places a power of two before.

The stream is planned as it is read. All cuts that every plan still open has in common are made; only
the rest stays in memory. Where that rest grows beyond OPEN ids, the cheapest plan is taken.

No rows move: a partition is packed as it lies, a sequence holds rows of one partition. A null text
counts as empty, and is the end id alone; repeated rows are packed one by one; texts of any length are
cut whole. Null ids stay null. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialis.llm.bpe import WORDS, Codec, codec, shipped
from spatialis.llm.common import text_chunks

#: Prices, in ids of padding, and the step of places inside long sentences.
SENTENCE, INSIDE, SEQUENCE, STEP = 8, 32, 16, 64
#: Characters of text that are planned at a time, and ids that may stay open between two plans.
CHUNK_CHARS, OPEN = 4_000_000, 1 << 20
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: What ends a sentence, by itself or before a space, and what may stand between.
STOPS, WIDE_STOPS, CLOSING = (b".", b"!", b"?"), tuple(c.encode() for c in "。！？"), b"\"')]}"


def merges_by_bytes(own: Codec) -> bool:
    """Whether merging the bytes of lowest rank, as tiktoken does, makes the merges of the vocabulary alone.

    It does if each token, made from its bytes by merges of lower rank, ends up as its own two parts: then
    by induction no other pair is ever merged, in any word.
    """
    ranks = {own.bytes_of[new]: i for i, (_, _, new) in enumerate(own.pair_of)}
    for rank, (a, b, new) in enumerate(own.pair_of):
        parts = [bytes([x]) for x in own.bytes_of[new]]
        while len(parts) > 2:
            found = min((ranks.get(x + y, rank), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if found[0] >= rank:
                return False
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
        if parts != [own.bytes_of[a], own.bytes_of[b]]:
            return False
    return all(new == 256 + i for i, (_, _, new) in enumerate(own.pair_of)) and sorted(own.first) == [*range(256)]


class Encoder:
    """A vocabulary's ids of texts, and which ids end sentences; `fast`: by tiktoken's merges."""

    def __init__(self, own: Codec, fast: bool) -> None:
        self.codec, self.core = own, None
        if fast:
            special = set(own.special.values())
            ranks = {b: i for i, b in own.bytes_of.items() if i not in special}
            self.core = tiktoken.Encoding("packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=own.special)
        size = max(own.bytes_of) + 1
        self.stop, self.wide, self.line, self.space = (np.zeros(size, bool) for _ in range(4))
        for i, b in own.bytes_of.items():
            self.stop[i], self.wide[i] = b.rstrip(CLOSING).endswith(STOPS), b.endswith(WIDE_STOPS)
            self.line[i], self.space[i] = b"\n" in b, b[:1] == b" "

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.core is None:
            return [np.array(x, np.int32) for x in self.codec.encode(texts)]
        return [self.core.encode_to_numpy(t, allowed_special="all").astype(np.int32) for t in texts]

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """For each id but the last, whether a sentence ends behind it."""
        a, b = ids[:-1], ids[1:]
        return (self.line[a] & ~self.line[b]) | (self.stop[a] & self.space[b]) | self.wide[a]


_encoders: dict[tuple[str, bool], Encoder] = {}


def price_list(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, size: int, final: bool) -> np.ndarray:
    """The price of a cut before each id and behind the last; -1 where none may be."""
    n = len(ids)
    price = np.full(n + 1, -1, np.int32)
    price[1:n][ends] = SENTENCE
    price[doc_ends] = 0
    price[0] = 0
    step = min(STEP, size)
    at = np.flatnonzero(price >= 0)
    more = (np.diff(at) - 1) // step
    price[np.repeat(at[:-1], more) + step * (1 + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))] = INSIDE
    if final:
        tail = price[max(0, n - size) :]
        tail[tail < 0] = INSIDE
    return price


def cheapest(price: np.ndarray, size: int) -> tuple[list[int], list[int], list[int]]:
    """Places of cuts, the least cost of a plan that ends at each, and the index of the place before."""
    there = price >= 0
    places = np.flatnonzero(there)
    index = np.cumsum(there) - 1
    own, before = [], []
    for power in (1 << t for t in range(size.bit_length())):
        if power < size:
            hit = np.flatnonzero(places >= power)
            hit = hit[there[places[hit] - power]]
            own.append(hit)
            before.append(index[places[hit] - power])
    own, before = np.concatenate([np.empty(0, np.int64), *own]), np.concatenate([np.empty(0, np.int64), *before])
    near = before[np.argsort(own, kind="stable")].tolist()
    until = np.cumsum(np.bincount(own, minlength=len(places))).tolist()
    place, fee = places.tolist(), (price[places] + SEQUENCE).tolist()
    cost, back, key = [0] * len(place), [0] * len(place), [0] * len(place)
    queue = deque([0])
    for j in range(1, len(place)):
        p = place[j]
        while place[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        c = key[i] + size - p
        for h in near[until[j - 1] : until[j]]:
            if cost[h] < c:
                c, i = cost[h], h
        cost[j], back[j] = c + fee[j], i
        key[j] = k = c + fee[j] + p
        while queue and key[queue[-1]] > k:
            queue.pop()
        queue.append(j)
    return place, cost, back


def settled(place: list[int], cost: list[int], back: list[int], size: int, final: bool) -> list[int]:
    """The places of cuts that can be made: all of them at the stream's end, else those that all open plans share."""
    last = len(place) - 1
    if not final:
        first = last
        while first and place[first - 1] >= place[-1] - size:
            first -= 1
        heap = [-i for i in reversed(range(first, len(place)))]
        known = set(range(first, len(place)))
        while len(heap) > 1:
            i = back[-heapq.heappop(heap)]
            if i not in known:
                known.add(i)
                heapq.heappush(heap, -i)
        last = -heap[0]
        if place[-1] - place[last] > OPEN:
            last = min(range(first, len(place)), key=lambda i: cost[i] + place[-1] - place[i])
    path = []
    while last:
        path.append(place[last])
        last = back[last]
    return path[::-1]


class Stream:
    """The open end of a partition's stream: ids, and its documents' ids, first places and counts of ids."""

    def __init__(self, size: int, first_sequence: int) -> None:
        self.size, self.sequence = size, first_sequence
        self.ids = np.empty(0, np.int32)
        self.doc_id = pa.array([], pa.int64())
        self.begin, self.total = np.empty(0, np.int64), np.empty(0, np.int64)

    def feed(self, doc_id: pa.Array, ids: list[np.ndarray], end_id: int) -> None:
        """Documents join the stream."""
        end = np.array([end_id], np.int32)
        total = np.fromiter(map(len, ids), np.int64, len(ids)) + 1
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(total) - total])
        self.ids = np.concatenate([self.ids, *(x for own in ids for x in (own, end))])
        self.total = np.concatenate([self.total, total])
        self.doc_id = pa.concat_arrays([self.doc_id, doc_id])

    def pack(self, encoder: Encoder, final: bool) -> Iterator[pa.RecordBatch]:
        """Cuts what is settled, and leaves the stream without it."""
        if not len(self.ids):
            return
        ends = self.begin + self.total
        price = price_list(self.ids, ends, encoder.sentence_ends(self.ids), self.size, final)
        cuts = np.array(settled(*cheapest(price, self.size), self.size, final), np.int64)
        if not len(cuts):
            return
        edges = np.unique(np.concatenate([[0], cuts, ends[ends < cuts[-1]]]))
        at, length = edges[:-1], np.diff(edges)
        doc, window = np.searchsorted(ends, at, side="right"), np.searchsorted(cuts, at, side="right")
        offset = at - np.concatenate([[0], cuts[:-1]])[window]
        some = max(1, (1 << 22) // self.size)
        for i in range(0, len(at), some):
            j = min(i + some, len(at))
            a, b = edges[i], edges[j]
            data = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(((edges[i : j + 1] - a) * 4).astype(np.int32)), pa.py_buffer(self.ids[a:b].astype("<u4"))])
            numbers = (at[i:j] - self.begin[doc[i:j]], length[i:j], self.total[doc[i:j]], self.sequence + window[i:j], offset[i:j])
            start, own, total, sequence, place = (pa.array(x, pa.int64()) for x in numbers)
            yield pa.RecordBatch.from_arrays([self.doc_id.take(pa.array(doc[i:j])), start, own, data, total, sequence, place], names=[x.split()[0] for x in PIECES.split(", ")])
        done = int(np.searchsorted(ends, cuts[-1], side="right"))
        self.sequence += len(cuts)
        self.ids = self.ids[cuts[-1] :].copy()
        self.doc_id, self.begin, self.total = pa.concat_arrays([self.doc_id[done:]]), self.begin[done:] - cuts[-1], self.total[done:]


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of a document: doc_id, start (the document's ids before it), length, ids (unsigned
    32-bit integers, little-endian), doc_tokens (its ids with the end id), sequence_id, offset (in the
    sequence, from 0)."""
    digest, content = shipped(docs, tokenizer)
    fast = merges_by_bytes(codec(digest, content))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (digest, fast) not in _encoders:
            _encoders[digest, fast] = Encoder(codec(digest, content), fast)
        encoder, stream = _encoders[digest, fast], None
        for b, texts in text_chunks(batches, CHUNK_CHARS):
            stream = stream or Stream(size, b.column(2)[0].as_py() << 40)
            stream.feed(b.column(0), encoder.encode([t or "" for t in texts]), end_id)
            yield from stream.pack(encoder, final=False)
        if stream:
            yield from stream.pack(encoder, final=True)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))
    return own.mapInArrow(run, PIECES)
