"""Awkward inputs that every corpus operator has to take."""

from __future__ import annotations

import pytest

WORDS = "the quick brown fox jumps over one lazy dog while seven wise owls watch from an old oak tree near some quiet river bank where green reeds sway in soft evening wind and frogs sing until dawn comes".split()
PASSAGE = " ".join(WORDS + [f"w{i}" for i in range(20)])
ROWS = [
    (1, PASSAGE, "en", "a"),
    (2, "start here " + PASSAGE + " and end", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n ", "en", "b"),
    (6, "x" * 60_000 + " " + "y " * 30_000, "en", "a"),
    (7, "Write to a.b@example.com or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.1. All rights reserved", "en", "b"),
    (7, "Write to a.b@example.com or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.1. All rights reserved", "en", "b"),
    (8, PASSAGE, "en", "a"),
    (None, PASSAGE + " tail", "en", "c"),
    (None, None, None, None),
    (9, "tiny text", "en", "a"),
    (10, "Tiny  text", "en", "a"),
    (11, "é\U0001f600 café a@b.co CC-BY <|endoftext|>", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit(1) for c in ("n_words", "kept", "copy", "shuffle_key", "labels", "score", "grade", "email", "term", "node", "runs", "rank", "ids", "toxic", "n_chars")})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
