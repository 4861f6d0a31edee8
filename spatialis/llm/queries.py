"""The registered queries of the corpus operators, over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialis.llm import ann, bpe, chat, fim, licenses, minhash, mixing, packing, pii, pivot_topk, substrings, toxicity, whitening
from spatialis.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return pivot_topk.pivot_top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spanned = pii.with_spans(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS[:4]]
    return spanned.select("doc_id", *counts, F.sha2(pii.span_string(pii.KINDS[:4]), 256).alias("base_sha256"), pii.span_string(pii.KINDS).alias("spans"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return substrings.drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked_calls(table(spark, sf_dir, "conversations"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return licenses.scan_licenses(docs).drop("text", "notices")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=85).drop("node")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(spark, docs, model).drop("text")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = fim.restore_text(fim.fill_in_middle(docs).drop("text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivot_topk": op1_pivot_topk,
    "op2_bpe": op2_bpe,
    "op3_ann": op3_ann,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_substrings": op6_substrings,
    "op7_chat": op7_chat,
    "op8_licenses": op8_licenses,
    "op9_minhash": op9_minhash,
    "op10_toxicity": op10_toxicity,
    "op11_fim": op11_fim,
    "op12_whitening": op12_whitening,
    "op13_packing": op13_packing,
}

ORACLE_SQL: dict[str, str] = {"op1_pivot_topk": pivot_topk.SQL, "op4_mixing": mixing.SQL, "op7_chat": chat.SQL, "op11_fim": fim.SQL}
