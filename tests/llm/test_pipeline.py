"""The pipeline's stages, each on what the one before it kept."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_texts import base, components


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept[name] = docs
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean, distinct = ([(r.doc_id, r.text) for r in kept[n].collect()] for n in ("toxicity", "near_dedup"))
    assert {k for k, _ in distinct} == {k for k, _, c in components(clean, 5, 80) if k == c}
    assert not any(base(r.text) for r in kept["pii"].collect() if r.text)
    assert kept["pii"].count() == len(distinct)
    assert {r.doc_id for r in kept["mixing"].collect()} <= {k for k, _ in distinct}
    assert kept["bpe"].count() == kept["mixing"].count()
    assert kept["bpe"].where(F.col("n_tokens") < 0).count() == 0


def test_stages_on_odd_and_empty_documents(spark, odd, empty, clashing):
    """Users' columns come out as they went in, whatever their names; odd and missing rows pass each stage."""
    mine = {c: F.lit(f"mine {c}") for c in ("toxic", "severity", "copy", "shuffle_key", "email", "Card", "term")}
    for docs in (odd.withColumn("n_chars", F.length("text")), empty, clashing.withColumns(mine)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, SF).cache()
            if name == "bpe":
                continue
            assert docs.columns == before.columns and (name == "mixing" or docs.count() <= n)
            if "Card" in docs.columns:
                assert docs.where(" or ".join(f"{c} <> 'mine {c}'" for c in mine)).count() == 0
            if n and name == "toxicity":
                assert docs.count() == n


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
