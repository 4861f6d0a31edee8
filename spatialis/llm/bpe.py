"""Byte-level BPE by a pair occurrence index.

The words of a chunk of texts are laid out as one array of symbols. An index maps each pair that has
a rank to all its positions; active ranks are taken in ascending order from a heap, every occurrence
of the rank's pair is merged, and the lists of the pairs that arise beside it are updated. As each token
comes of one merge alone (checked on loading), a merge can only bring up higher ranks, so each word
sees exactly the order of merges that it would see by itself.

Letters and numbers are those of Unicode 16, as the vocabulary's own library has them.

Null texts count as empty; empty texts have no tokens; repeated rows are encoded alike; texts of any
length are taken whole. Columns that clash with an output column are replaced, all others pass through
unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatialis.llm.common import text_chunks

#: Characters of text that are encoded at a time, and words that a Python worker remembers.
CHUNK_CHARS, REMEMBERED = 4_000_000, 250_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: How byte-level BPE splits text into words before the merges.
WORDS = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: What Unicode 16 added to the letters and numbers of Unicode 15.1, as ranges.
LETTERS_16 = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Characters below this are split by the standard library, which is faster over so few classes.
LATIN_END = 0x250


def latin_pattern() -> re.Pattern[str]:
    """WORDS for texts whose characters all lie below LATIN_END."""

    def members(major: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == major)

    letter, number, space = members("L"), members("N"), r"\t-\r\x20\x85\xa0"
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def _ranges(points: np.ndarray) -> str:
    """A character class's inside for code points in ascending order."""
    cuts = np.flatnonzero(np.diff(points) != 1)
    first, last = points[np.concatenate([[0], cuts + 1])], points[np.concatenate([cuts, [len(points) - 1]])]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist()))


@cache
def pinned_pattern() -> tuple[regex.Pattern[str], re.Pattern[str] | None]:
    """WORDS with letters and numbers of Unicode 16 written out, and a pattern of the characters that the
    regex library, whose tables are of another version, puts elsewhere (None: it has no such)."""
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = "".join(map(chr, points))
    kind = np.array([unicodedata.category(c)[0] for c in every])
    odd = np.zeros(len(points), bool)
    inside = {}
    for name, added in (("L", LETTERS_16), ("N", NUMBERS_16)):
        own = kind == name
        for a, b in added:
            own |= (points >= a) & (points <= b)
        there = np.zeros(len(points), bool)
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            there[m.start() : m.end()] = True
        odd |= own != there
        inside[name] = _ranges(points[own])
    pinned = WORDS.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"[^\p{{White_Space}}{inside['L']}{inside['N']}]")
    for name in inside:
        pinned = pinned.replace(rf"\p{{{name}}}", f"[{inside[name]}]")
    return regex.compile(pinned), re.compile(f"[{_ranges(points[odd])}]") if odd.any() else None


class Codec:
    """A vocabulary's encoder and decoder, from the bytes of its file."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        vocab, byte_of = spec["model"]["vocab"], byte_letters()
        self.first = np.array([vocab[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])])
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        self.pair_of = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        made: set[int] = set()
        for a, b, new in self.pair_of:
            if new in made:
                raise ValueError("two merges make the same token: ascending ranks would not be the order of merges")
            made.add(new)
        keys = np.array([a << 32 | b for a, b, _ in self.pair_of])
        self.key_ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.key_ranks]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.latin, self.any, self.beyond = latin_pattern(), regex.compile(WORDS), re.compile(f"[^\\0-{chr(LATIN_END - 1)}]")
        self.pinned, self.odd = pinned_pattern()
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str | int, tuple[int, ...]] = {}

    def rank_at(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair key, or -1."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.key_ranks[at], -1)

    def learn(self, words: list[str]) -> None:
        """Puts the ids of words that aren't known yet into `known`."""
        spelt = [w.encode() for w in words]
        sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        n = int(sizes.sum()) + len(spelt)
        sym = np.full(n, -1, np.int64)
        sym[np.arange(n - len(spelt)) + np.repeat(np.arange(len(spelt)), sizes)] = self.first[np.frombuffer(b"".join(spelt), np.uint8)]
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(places: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> None:
            """Adds places to the lists of the pairs (a, b) that stand there, if they have ranks."""
            ranks = self.rank_at(a << 32 | b)
            hit = ranks >= 0
            ranks, places = ranks[hit], places[hit]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for rank, i, j in zip(ranks[edges[:-1]].tolist(), edges, edges[1:]):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(places[i:j])

        start = np.flatnonzero((sym[:-1] >= 0) & (sym[1:] >= 0))
        note(start, sym[start], sym[start + 1])
        while active:
            rank = heapq.heappop(active)
            places = np.unique(np.concatenate(index.pop(rank)))
            a, b, new = self.pair_of[rank]
            after = right[places]
            fits = (sym[places] == a) & (sym[after] == b)  # else an earlier merge took one of the two
            p, q = places[fits], after[fits]
            if a == b and len(p) > 1 and np.isin(p, q, assume_unique=True).any():
                own, last = [], -1
                for i, (x, y) in enumerate(zip(p.tolist(), q.tolist())):
                    if x != last:
                        own.append(i)
                        last = y
                p, q = p[own], q[own]
            if not len(p):
                continue
            after = right[q]
            sym[p], sym[q], right[p], left[after] = new, -2, after, p
            beside = sym[after] >= 0
            note(p[beside], new, sym[after[beside]])
            before = left[p]
            before = before[sym[before] >= 0]
            note(before, sym[before], new)
        rest = sym[sym != -2]
        ends, ids = np.flatnonzero(rest == -1).tolist(), rest.tolist()
        at = 0
        for w, end in zip(words, ends):
            self.known[w] = tuple(ids[at:end])
            at = end + 1

    def words(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.latin.findall(text)
        return (self.pinned if self.odd and self.odd.search(text) else self.any).findall(text)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        cut: list[list[str | int]] = []
        for text in texts:
            if self.split is None or not any(s in text for s in self.special):
                cut.append(self.words(text))
                continue
            parts: list[str | int] = []
            for part in self.split.split(text):
                parts.extend([self.special[part]] if part in self.special else self.words(part))
            cut.append(parts)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = set(chain.from_iterable(cut)).difference(self.known)
        for x in [x for x in fresh if isinstance(x, int)]:
            self.known[x] = (x,)
            fresh.discard(x)
        if fresh:
            self.learn(list(fresh))
        for words in cut:
            yield list(chain.from_iterable(map(self.known.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; an id that the vocabulary lacks adds nothing."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def shipped(df: DataFrame, tokenizer: str) -> tuple[str, Broadcast[bytes]]:
    """The vocabulary file's bytes (some MB, whatever the data) for executors, and their digest. Only the
    driver reads the file."""
    with open(tokenizer, "rb") as f:
        content = f.read()
    return hashlib.sha256(content).hexdigest(), df.sparkSession.sparkContext.broadcast(content)


def codec(digest: str, content: Broadcast[bytes]) -> Codec:
    """One codec for each vocabulary and Python process."""
    if digest not in _codecs:
        _codecs[digest] = Codec(content.value)
    return _codecs[digest]


def _added(b: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, values], names=[*b.schema.names, name])


def bpe_encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`df` with the array column `ids`."""
    rest = df.drop(ids)
    digest, content = shipped(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(digest, content)
        for b, texts in text_chunks(batches, CHUNK_CHARS, text):
            yield _added(b, ids, pa.array(own.encode([t or "" for t in texts]), pa.list_(pa.int32())))

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`df` with the column `text` of what `ids` decode to; null ids give the empty text."""
    rest = df.drop(text)
    digest, content = shipped(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(digest, content)
        for b in batches:
            values = b.column(b.schema.get_field_index(ids)).to_pylist()
            yield _added(b, text, pa.array([own.decode(x or []) for x in values], pa.string()))

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(text, T.StringType())]))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes each document and decodes its ids, in one pass: the count of ids and digests of both.

    One row for each input row. The ids themselves don't leave the Python worker, as they are several
    times the size of the text.
    """
    digest, content = shipped(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(digest, content)
        for b, texts in text_chunks(batches, CHUNK_CHARS):
            rows = []
            for ids in own.encode([t or "" for t in texts]):
                joined = ",".join(map(own.text_of.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
            n, first, second = zip(*rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(first), pa.array(second)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST)
