"""Toxicity by cumulative-link ordinal regression over sparse text features.

Grades are ordered: 0 is clean, 1 to GRADES - 1 are toxic, by severity. One weight vector serves all
thresholds: P(grade > j) = sigmoid(w.x - t_j) with t_0 < t_1 < ..., fitted by maximum likelihood with
a ridge penalty. Features are the distinct words of a text and the words' first letters (3, 4 and 5 of
them, which catch compounds), hashed into BUCKETS. `labels` only say toxic or not, so the grade of a
toxic row comes from how many distinct indicators it holds: features that toxic rows have clearly more
often than others in the same sample (a word and its beginnings are up to four).

The model is fitted on at most SAMPLE labelled rows, those of the smallest hash of their id, as far as
their texts have SAMPLE_CHARS characters together; these bounds are all that the driver ever holds of the
corpus. Texts of more than a hundredth of SAMPLE_CHARS aren't sampled. Every row of the documents is scored.

A row is toxic if its score w.x is CUT or more, that is if its odds of being toxic are twice those of a text
without any known feature, whatever the share of toxic rows in the sample. A text without features has score
0 and is never toxic. (A fixed probability would reject all such texts where half of the sample is toxic; cuts
chosen on held-out halves of the sample were no better on the given labels.)

Null texts count as empty, and empty texts score as clean rows do by the thresholds alone; labels that
are null, or that contradict each other for one id, are left out; without any labelled row of either
kind nothing is rejected. Of an id with several texts the smallest is learned from. Repeated rows score
alike; very long texts are scored whole. Columns p_toxic, severity, grade and toxic are replaced, all
others pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatialis.llm.common import free_name, staged

BUCKETS, SAMPLE, SAMPLE_CHARS, GRADES = 1 << 18, 8_000, 120_000_000, 4
#: Distinct indicators from which a toxic row has grade 2 and 3.
STEPS = (2, 5)
#: A feature needs this many sampled rows to have a weight; the least score of a toxic row (log of odds).
LEAST_ROWS, CUT = 2, 0.7
_WORD = re.compile(r"[^\W\d_]+")


_buckets: dict[str, tuple[int, ...]] = {}


def features(text: str | None) -> list[int]:
    """The distinct features of a text, sorted."""
    words = set(_WORD.findall((text or "").lower()))
    if len(_buckets) > 100_000:
        _buckets.clear()
    for w in words.difference(_buckets):
        _buckets[w] = tuple(zlib.crc32(x.encode()) % BUCKETS for x in (w, *(f"{w[:n]}*" for n in (3, 4, 5) if len(w) > n)))
    return sorted(set(chain.from_iterable(map(_buckets.__getitem__, words))))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Scores of n rows from their features."""
        return np.bincount(row, self.weights[at], n)

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each score and threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None], -60, 60)))


def grades(at: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades of sampled rows: 0, or by how many indicators a toxic row holds. at, row: the feature and
    the row of each entry."""
    n = toxic.sum()
    of_toxic = np.bincount(at[toxic[row]], minlength=BUCKETS)
    of_rest = np.bincount(at, minlength=BUCKETS) - of_toxic
    odds = np.log((of_toxic + 0.5) / (n + 1)) - np.log((of_rest + 0.5) / (len(toxic) - n + 1))
    marks = (odds > np.log(20)) & (of_toxic >= max(3, 0.003 * n))
    hits = np.bincount(row[marks[at]], minlength=len(toxic))
    return np.where(toxic, 1 + (hits[:, None] >= np.array(STEPS)[None]).sum(axis=1), 0)


def fit_ordinal(at: np.ndarray, row: np.ndarray, y: np.ndarray, levels: int = GRADES, ridge: float = 2e-3, rounds: int = 100, watch: Callable | None = None) -> OrdinalModel:
    """Weights and thresholds of greatest penalised likelihood, by Adam over all rows at once. `watch` gets
    the function that is minimised and where it starts."""
    x = len(y)
    often = np.bincount(at, minlength=BUCKETS) >= LEAST_ROWS
    row, at = row[often[at]], at[often[at]]
    used = np.flatnonzero(often)
    col = (np.cumsum(often, dtype=np.int32) - 1)[at]
    # Blocks of rows keep what a round computes small beside the sample itself.
    cuts = [*range(0, x, 1000), x]
    ends = np.searchsorted(row, cuts).tolist()
    blocks = list(zip(cuts, cuts[1:], ends, ends[1:]))
    share = np.array([(y > j).mean() for j in range(levels - 1)]).clip(1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    params = np.concatenate([np.zeros(len(used)), [first[0]], np.log(np.maximum(np.diff(first), 0.05))])
    step, m, v = 0.05, np.zeros_like(params), np.zeros_like(params)
    k = len(used)

    def value(params: np.ndarray) -> tuple[float, np.ndarray]:
        """The penalised negative log-likelihood of a row, and its gradient."""
        gaps = np.exp(params[k + 1 :])
        t = params[k] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.concatenate([np.bincount(row[a:b] - i, params[col[a:b]], j - i) for i, j, a, b in blocks])
        cdf = np.concatenate([np.zeros((x, 1)), 1 / (1 + np.exp(-np.clip(t[None] - s[:, None], -60, 60))), np.ones((x, 1))], axis=1)
        own = np.arange(x)
        p = np.maximum(cdf[own, y + 1] - cdf[own, y], 1e-12)
        slope = cdf * (1 - cdf)
        by_score = (1 - cdf[own, y + 1] - cdf[own, y]) / x
        by_t = np.array([(np.where(y == j, -slope[:, j + 1], 0) + np.where(y == j + 1, slope[:, j + 1], 0)) @ (1 / p) / x for j in range(levels - 1)])
        g = np.concatenate([sum(np.bincount(col[a:b], by_score[row[a:b]], k) for _, _, a, b in blocks) + ridge * params[:k], [by_t.sum()], [by_t[j + 1 :].sum() * gaps[j] for j in range(levels - 2)]])
        return float(-np.log(p).mean() + ridge / 2 * (params[:k] ** 2).sum()), g

    if watch is not None:
        watch(value, params)
    for i in range(1, rounds + 1):
        _, g = value(params)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params -= step * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = params[:k]
    return OrdinalModel(weights, params[k] + np.concatenate([[0], np.cumsum(np.exp(params[k + 1 :]))]))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """Texts and flags of at most `sample` labelled ids, those of the smallest hash, a text for each and
    `chars` characters at most."""
    ids = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where("toxic = most")
        .select(F.col("doc_id").alias("label_id"), "toxic")
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"))
    # Copies of one id would make the sample longer than its bound; a text each is enough.
    texts = staged(texts.groupBy("label_id", "toxic").agg(F.min("text").alias("text")), "sample")
    # A running sum over at most `sample` lengths; what is too long for it is left out, and the rest goes on.
    order = Window.orderBy(F.xxhash64("label_id"), "label_id")
    length = F.length(F.coalesce("text", F.lit("")))
    sizes = texts.select("label_id", length.alias("length")).where(F.col("length") <= max(100, chars // 100))
    held = sizes.select("label_id", F.sum("length").over(order).alias("size")).where(F.col("size") <= chars).select("label_id")
    return texts.join(F.broadcast(held), "label_id").select("label_id", "text", "toxic")


def fit_sample(at: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> OrdinalModel:
    """The model of sampled rows from their features and flags."""
    return fit_ordinal(at, row, grades(at, row, toxic))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label_id": b["label_id"], "toxic": b["toxic"], "x": [features(t) for t in b["text"]]})

    rows = labelled_sample(docs, labels, sample).mapInPandas(run, "label_id long, toxic int, x array<int>").toArrow().sort_by("label_id")
    toxic = rows["toxic"].to_numpy() > 0
    if not toxic.any() or toxic.all():
        return OrdinalModel(np.zeros(BUCKETS), np.arange(1, GRADES) * 50.0)
    lists = rows["x"].combine_chunks()
    row = np.repeat(np.arange(len(rows), dtype=np.int32), pc.list_value_length(lists).to_numpy())
    return fit_sample(lists.flatten().to_numpy(), row, toxic)


SCORES = T.StructType([T.StructField("p_toxic", T.DoubleType()), T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])


def score_toxicity(spark: SparkSession, docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """`docs` with p_toxic = P(grade > 0), severity = expected grade, grade = the highest that is more
    likely than not to be reached (0 if no row of the sample was toxic), and toxic = (score >= CUT). The model
    has a fixed size and is broadcast."""
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, thresholds = shared.value
        own = OrdinalModel(weights, thresholds)
        for b in batches:
            scores = np.array([float(weights[at].sum(dtype=np.float64)) if (at := features(t)) else 0.0 for t in b])
            above = own.above(scores)
            yield pd.DataFrame({"p_toxic": above[:, 0], "severity": above.sum(axis=1), "grade": (above >= 0.5).sum(axis=1).astype("int32"), "toxic": scores >= CUT})

    name = free_name(docs, "tox")
    scored = docs.withColumn(name, F.pandas_udf(run, SCORES)(F.col(text)))
    return scored.withColumns({c: F.col(f"{name}.{c}") for c in SCORES.names}).drop(name)
