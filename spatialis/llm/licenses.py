"""License scans: fuzzy search for short notices.

A text is lower-cased (A-Z) and cut into words; matching runs over the words joined by single spaces.
Base phrases are counted where their words stand consecutively. Each notice may differ by a bounded
number of edits (insertions, deletions, substitutions of characters). By the pigeonhole principle, of
(edits + 1) pieces of a notice one must occur unchanged, so the pieces are exact seeds that one
automaton finds; around each seed the regex library's bounded-error matching verifies the edits and
gives the span. Spans of a notice are taken from left to right: of the matches that begin where the first
one does or overlap it, the best counts, and the search goes on behind it, so nothing between two spans
of a notice matches it.

Null texts count as empty; an empty text has no words, no labels and score 0. Copies and repeated rows
score alike; texts are scanned whole. Columns that clash with an output column are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatialis.llm.common import free_name

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that are searched with errors, their labels; the default, not a bound.
NOTICES = {
    "general public license": "gpl",
    "all rights reserved": "reserved",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "this work is licensed under a creative commons": "cc",
    "released into the public domain": "public-domain",
    "permission to use copy modify and or distribute this software": "isc",
}
#: Edits allowed: one for this many characters of a notice.
CHARS_PER_EDIT = 10
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
COLUMNS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("notices", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("edits", T.IntegerType())]))),
    ]
)


def edits_of(notice: str) -> int:
    return len(notice) // CHARS_PER_EDIT


Notice = tuple[str, str, int, regex.Pattern[str], regex.Pattern[str]]


@cache
def _searcher(wanted: tuple[tuple[str, str], ...]) -> tuple[ahocorasick.Automaton, list[Notice]]:
    """The seeds' automaton, and (notice, label, edits, pattern of the first match, of the best) of each
    of the wanted (notice, label)."""
    notices, seeds = [], {}
    for i, (notice, label) in enumerate(wanted):
        e = edits_of(notice)
        pattern = f"(?:{regex.escape(notice, literal_spaces=True)}){{e<={e}}}"
        notices.append((notice, label, e, regex.compile(pattern), regex.compile(pattern, regex.BESTMATCH)))
        cuts = [round(j * len(notice) / (e + 1)) for j in range(e + 2)]
        for a, b in zip(cuts, cuts[1:]):
            seeds.setdefault(notice[a:b], []).append((i, a))
    found = ahocorasick.Automaton()
    for seed, uses in seeds.items():
        found.add_word(seed, (len(seed), uses))
    found.make_automaton()
    return found, notices


def fuzzy_notices(joined: str, wanted: dict[str, str] | None = None) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of notices in words joined by spaces, in order, each notice's spans
    apart from one another."""
    automaton, notices = _searcher(tuple((NOTICES if wanted is None else wanted).items()))
    near: dict[int, list[list[int]]] = {}
    for end, (size, uses) in automaton.iter(joined):
        for i, offset in uses:
            notice, _, e, _, _ = notices[i]
            a = max(0, end + 1 - size - offset - e)
            b = min(len(joined), end + 1 - size - offset + len(notice) + e)
            spans = near.setdefault(i, [])
            if spans and a <= spans[-1][1]:
                spans[-1][1], spans[-1][0] = max(b, spans[-1][1]), min(a, spans[-1][0])
            else:
                spans.append([a, b])
    out = []
    for i, spans in near.items():
        notice, label, e, first, best = notices[i]
        for a, b in spans:
            at = a
            while at < b and (m := first.search(joined, at, b)):
                # Of what overlaps the first match, the best: a whole notice may begin a few edits on.
                m = best.search(joined, m.start(), min(b, m.start() + len(notice) + 2 * e)) or m
                out.append((label, m.start(), m.end(), sum(m.fuzzy_counts)))
                at = max(m.end(), at + 1)
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan(text: str | None, wanted: dict[str, str] | None = None) -> tuple:
    """The values of COLUMNS for one text."""
    text = text or ""
    words = WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))
    joined = " ".join(words)
    padded = f" {joined} "
    # Where each word begins in `joined`.
    places = list(accumulate((len(w) + 1 for w in words), initial=0))
    starts: list[int] = []
    labels: set[str] = set()
    for phrase, label in BASE.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            starts.append(bisect_left(places, at))
            labels.add(label)
            at = padded.find(f" {phrase} ", at + 1)
    notices, score = [], 1.0 if starts else 0.0
    every = set(labels)
    for label, a, b, edits in fuzzy_notices(joined, wanted):
        every.add(label)
        score = max(score, 1 - edits / max(1, b - a))
        notices.append((label, bisect_right(places, a) - 1, bisect_right(places, max(a, b - 1)) - 1, edits))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, notices


def scan_licenses(docs: DataFrame, text: str = "text", wanted: dict[str, str] | None = None) -> DataFrame:
    """`docs` with the columns of COLUMNS; `notices` lists what was found with its first and last word
    and its edits. `wanted` maps notices, lower-cased words joined by spaces, to labels (default: NOTICES)."""
    wanted = {k: v for k, v in (NOTICES if wanted is None else wanted).items() if k}

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([scan(t, wanted) for t in b], columns=COLUMNS.names)
            yield out.astype({c: "Int64" for c in COLUMNS.names[:4]})

    own = free_name(docs, "license")
    found = docs.withColumn(own, F.pandas_udf(run, COLUMNS)(F.col(text)))
    return found.withColumns({c: F.col(f"{own}.{c}") for c in COLUMNS.names}).drop(own)
