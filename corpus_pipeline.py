"""A corpus pipeline: toxic documents go, near duplicates go, personal data is replaced, sources are
mixed, and the rest is encoded. Each stage is written as Parquet and read again by the next.

Null texts count as empty in every stage: they are never toxic, never near duplicates, hold no personal
data, are mixed like others and have no tokens. Null ids and sources are kept (as mixing.py says, rows of null
id are drawn by their text). Very long texts go through whole. Repeated rows are near duplicates, so one of
them stays; near duplicates that tie are settled as minhash.py says. Without usable labels nothing is toxic. All
stages but the last return the columns of the documents as they came, also where an operator has a column
of that name. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialis.llm import bpe, minhash, mixing, pii, toxicity
from spatialis.llm.common import free_name, staged, table
from spatialis.llm.queries import TOKENIZER


def beside(docs: DataFrame, made: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stage returns, with the columns of `docs` alone; those named as columns that the stage makes are
    put aside under free names meanwhile."""
    aside = {c: free_name(docs, c) for c in docs.columns if c.lower() in made}
    out = stage(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return beside(docs, tuple(toxicity.SCORES.names), lambda d: toxicity.score_toxicity(spark, d, model).where("not toxic"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return minhash.drop_near_duplicates(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and what discloses it, replaced."""
    replaced = beside(docs, pii.KINDS, lambda d: pii.sanitised(pii.with_spans(d)))
    if "n_chars" not in docs.columns:
        return replaced
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, repeated and left out by their source's target weight, in random order."""
    return beside(docs, ("copy", "shuffle_key"), mixing.mix_sources)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's count of tokens and digests of its ids and of their decoding."""
    return bpe.bpe_round_trip(docs, TOKENIZER)


STAGES = [("toxicity", clean), ("near_dedup", distinct), ("pii", private), ("mixing", mixed), ("bpe", encoded)]

#: SQL can't express the trained model of the first stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
