"""Fill-in-middle and packing against brute force."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialis.llm import bpe, fim, packing
from spatialis.llm.queries import TOKENIZER
from tests.conftest import SF


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def by_hand(doc_id, text):
    """n, form, prefix_chars, middle_chars, output by plain string work."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("step", [50, fim.STEP])
def test_fim_equals_plain_strings(spark, odd, step):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(["<P", "a<S>b", "S>M>P>", "<<>>", "\x00\x7f\n\r a1", "é́\U0001f600 x", "<" * 50] * 6)], "doc_id long, text string")
    kept, fim.STEP = fim.STEP, step
    try:
        for docs in (odd.select("doc_id", "text"), more, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")):
            got = fim.restore_text(fim.fill_in_middle(docs)).collect()
            assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == collections.Counter((r.doc_id, *by_hand(r.doc_id, r.text)) for r in docs.collect())
            assert all(r.restored == (r.text or "") for r in got)
    finally:
        fim.STEP = kept


def test_fim_columns(clashing, empty):
    out = fim.fill_in_middle(clashing.withColumns({"n": F.lit(1), "fim_0": F.lit(2), "_fim_1": F.lit(3)}))
    assert out.where("fim_0 = 2 and _fim_1 = 3 and kept = 1").count() == clashing.count()
    assert fim.restore_text(fim.fill_in_middle(empty)).count() == 0


def least_cost(price, size):
    """The cheapest plan by trying every pair of places."""
    places = [int(p) for p in np.flatnonzero(price >= 0)]
    cost = {0: 0}
    for p in places[1:]:
        cost[p] = min(cost[q] + (0 if (p - q) & (p - q - 1) == 0 else size - (p - q)) for q in places if p - size <= q < p) + int(price[p]) + packing.SEQUENCE
    return cost[places[-1]]


def test_cheapest_plan():
    rng = np.random.default_rng(3)
    for case in range(40):
        size, n = int(rng.choice([2, 7, 16, 33])), int(rng.integers(1, 300))
        doc_ends = np.unique(np.append(rng.integers(1, n + 1, size=n // int(rng.integers(3, 40)) + 1), n))
        price = packing.price_list(np.zeros(n, np.int32), doc_ends, rng.random(n - 1) < 0.1, size, final=bool(case % 2))
        place, cost, back = packing.cheapest(price, size)
        path = [0, *packing.settled(place, cost, back, size, final=True)]
        assert path[-1] == n and max(np.diff(path)) <= size
        spent = sum((0 if length & (length - 1) == 0 else size - length) + packing.SEQUENCE for length in np.diff(path).tolist()) + sum(int(price[p]) for p in path[1:])
        assert spent == cost[-1] == least_cost(price, size)


def whole(docs, out, size):
    """Checks pieces against the library's ids; returns sequences' lengths."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id, tuple(t.encode(r.text or "", add_special_tokens=False).ids) + (1,)] += 1
    rows = out.collect()
    sequences = collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        sequences[r.sequence_id].append((r.offset, r.length, r.doc_id, r.start, r.doc_tokens, ids))
    got, left = collections.Counter(), {}
    for s in sorted(sequences):
        at = 0
        for offset, length, doc_id, start, total, ids in sorted(sequences[s], key=lambda x: x[0]):
            assert offset == at and length > 0
            at += length
            # Documents lie whole and in order along the sequences of a partition.
            key = doc_id, total, start
            before = left.pop(key, ()) if start else ()
            assert len(before) == start
            if start + length == total:
                got[doc_id, (*before, *ids.tolist())] += 1
            else:
                left[doc_id, total, start + length] = (*before, *ids.tolist())
        assert at <= size
    assert not left and got == want
    return [sum(x[1] for x in v) for v in sequences.values()]


@pytest.mark.parametrize(("size", "chunk", "open_ids"), [(16, 200, 64), (2048, 3000, 1 << 20), (2048, packing.CHUNK_CHARS, 1 << 20)])
def test_pieces_are_whole(spark, odd, size, chunk, open_ids):
    kept = packing.CHUNK_CHARS, packing.OPEN
    packing.CHUNK_CHARS, packing.OPEN = chunk, open_ids
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60) if size == 16 else spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
        for own in (odd.select("doc_id", "text"), docs.repartition(3, "doc_id").cache()):
            lengths = whole(own, packing.pack_documents(own, TOKENIZER, size=size), size)
            if size == 2048 and sum(lengths) > 100_000:
                assert sum(0 if x & (x - 1) == 0 else size - x for x in lengths) < 0.02 * sum(lengths) + 3 * 300
    finally:
        packing.CHUNK_CHARS, packing.OPEN = kept


def test_chunks_don_t_change_plans(spark):
    """Cuts are made when all open plans share them, so reading in small steps gives the plan of the whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").coalesce(1)
    rows = lambda: sorted(packing.pack_documents(docs, TOKENIZER).collect())
    once = rows()
    kept = packing.CHUNK_CHARS
    try:
        for packing.CHUNK_CHARS in (1, 20_000):
            assert rows() == once
    finally:
        packing.CHUNK_CHARS = kept


def test_sequences_of_merged_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(5, "doc_id").cache()
    out = packing.pack_documents(docs, TOKENIZER).coalesce(1)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("k"), F.count("*").alias("m")).where("n > 2048 or k <> m").count() == 0


def test_empty_and_null_documents(spark, empty, clashing):
    assert packing.pack_documents(empty, TOKENIZER).count() == 0
    rows = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "<|endoftext|> a")], "doc_id long, text string").coalesce(1)
    got = packing.pack_documents(rows, TOKENIZER).collect()
    assert [(r.doc_id, r.start, r.doc_tokens) for r in got[:3]] == [(1, 0, 1), (1, 0, 1), (None, 0, 1)]
    assert np.frombuffer(got[3].ids, "<u4").tolist() == [50256, 257, 1]
    assert packing.pack_documents(clashing, TOKENIZER).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert all(zlib.crc32(r.ids) == r.crc for r in packing.pack_documents(rows, TOKENIZER).withColumn("crc", F.crc32("ids")).collect())


def test_fast_merges_are_those_of_the_vocabulary():
    own = bpe.Codec(open(TOKENIZER, "rb").read())
    assert packing.merges_by_bytes(own)
    fast, slow = packing.Encoder(own, True), packing.Encoder(own, False)
    texts = ["aaaaaaaaaaaaaa bbbb abababab  \n\n x", "It's 1234567 o'clock!!  —“ok” 東京。 мир　x", "", "<|endoftext|>x <|endoftext|", "\t \t\r\nz" * 9]
    texts += ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) + " x" for a in range(0, 0x32000, 64)]
    assert [x.tolist() for x in fast.encode(texts)] == [x.tolist() for x in slow.encode(texts)]
    own.pair_of[5000] = (*own.pair_of[4999][:2], own.pair_of[5000][2])
    assert not packing.merges_by_bytes(own)
