"""Severity of toxic language by cumulative-link ordinal regression on sparse word features.

Grades are ordered: 0 is harmless; labelled toxic documents are graded 1 to 3 by how dense the
words are that mark toxic documents. P(grade <= k) = sigmoid(threshold_k - w.x) shares one
weight per word over all ordered thresholds. Features are the square roots of the rates of the marking words.

The model is fitted on a bounded sample of labelled rows (``max_labelled``, in hash order of the id); word statistics of
the sample are grouped by Spark, and the driver gets at most ``max_words`` words and the sample's counts of them. All
documents are scored by one pass over their whole texts.

Defined results: null text and texts without words have grade 0 with the probability of no marking word; rows with the
same id are separate rows; without labels of both kinds nothing can be learnt and nothing is called toxic; an empty table gives no
rows. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.text import letter_words, lower_az, saved

MAX_LABELLED = 20_000
MAX_WORDS = 256
CALL_FROM = 0.3  # probability of any toxic grade from which a document is called toxic
MIN_DOCS = 5  # labelled documents that a marking word stands in at least
GRADES = 4
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@dataclass(frozen=True)
class OrdinalModel:
    """``words`` to columns, one weight per column, rising thresholds between the grades."""

    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def features(self, counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return np.sqrt(100 * counts / np.maximum(n_words, 1)[:, None])

    def at_most(self, features: np.ndarray) -> np.ndarray:
        """P(grade <= k) for every k but the last."""
        return _sigmoid(self.thresholds[None, :] - (features @ self.weights)[:, None])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(features: np.ndarray, grades: np.ndarray, n_grades: int, *, steps: int = 600, rate: float = 0.05,
                penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam; the thresholds rise because their gaps are exponentials."""
    n, d = features.shape
    theta = np.zeros(d + n_grades - 1)
    theta[d] = 1.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def thresholds(t: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate((t[d: d + 1], np.exp(t[d + 1:]))))

    for step in range(1, steps + 1):
        cuts = thresholds(theta)
        score = features @ theta[:d]
        below = np.hstack([np.zeros((n, 1)), _sigmoid(cuts[None, :] - score[:, None]), np.ones((n, 1))])
        upper, lower = below[np.arange(n), grades + 1], below[np.arange(n), grades]
        mass = np.maximum(upper - lower, 1e-9)
        d_upper, d_lower = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        d_cuts = np.zeros(n_grades - 1)
        np.add.at(d_cuts, np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, d_upper, 0))
        np.add.at(d_cuts, np.maximum(grades - 1, 0), np.where(grades > 0, -d_lower, 0))
        gradient = np.empty_like(theta)
        gradient[:d] = features.T @ (d_upper - d_lower) / n + penalty * theta[:d]
        from_right = np.cumsum(d_cuts[::-1])[::-1]
        gradient[d] = -from_right[0] / n
        gradient[d + 1:] = -from_right[1:] * np.exp(theta[d + 1:]) / n
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:d], thresholds(theta)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED,
        max_words: int = MAX_WORDS, min_docs: int = MIN_DOCS) -> OrdinalModel | None:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic (0 or 1). None if one kind of label is missing."""
    chosen = (labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    chosen = saved(chosen, spark, "toxic-labels")
    sample = saved(docs.join(chosen, "doc_id").select(
        "doc_id", "toxic", letter_words(lower_az(F.col("text"))).alias("words")).dropDuplicates(["doc_id"]), spark, "toxic-sample")
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return None
    in_toxic, in_clean = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    odds = F.log((in_toxic + 0.5) / (totals[1] + 1)) - F.log((in_clean + 0.5) / (totals[0] + 1))
    marking = (sample.select("toxic", F.explode(F.array_distinct("words")).alias("word")).groupBy("word")
               .agg(in_toxic.alias("toxic_docs"), odds.alias("odds"))
               .filter((F.col("toxic_docs") >= min_docs) & (F.col("odds") > 1))
               .orderBy(F.col("odds").desc(), "word").limit(max_words).collect())
    words = {r["word"]: i for i, r in enumerate(marking)}
    if not words:
        return None
    held = (sample.select("doc_id", F.explode("words").alias("word")).filter(F.col("word").isin(list(words)))
            .groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("held")))
    rows = (sample.join(held, "doc_id", "left").select("doc_id", "toxic", F.size("words").alias("n_words"), "held")
            .orderBy("doc_id").collect())
    counts = np.zeros((len(rows), len(words)))
    for i, row in enumerate(rows):
        for word, n in (row["held"] or {}).items():
            counts[i, words[word]] = n
    n_words = np.array([r["n_words"] for r in rows], dtype=float)
    toxic = np.array([r["toxic"] for r in rows], dtype=int)
    density = counts.sum(axis=1) / np.maximum(n_words, 1)
    cuts = np.quantile(density[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    grades = np.where(toxic == 1, 1 + np.searchsorted(cuts, density, side="left"), 0)
    model = OrdinalModel(words, np.zeros(len(words)), np.zeros(GRADES - 1))
    weights, thresholds = fit_ordinal(model.features(counts, n_words), grades, GRADES)
    return OrdinalModel(words, weights, thresholds)


_RESULT = "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean"


def _score(frames: Iterator[pd.DataFrame], model: OrdinalModel | None) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if model is None:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "expected_severity": 0.0, "grade": 0, "p_toxic": 0.0, "toxic": False})
            continue
        counts, n_words = np.zeros((len(frame), len(model.words))), np.zeros(len(frame))
        columns = model.words
        for i, text in enumerate(frame["text"]):
            found = _WORD.findall(text or "")
            n_words[i] = len(found)
            for word in found:
                if word in columns:
                    counts[i, columns[word]] += 1
        at_most = model.at_most(model.features(counts, n_words))
        mass = np.diff(np.hstack([np.zeros((len(frame), 1)), at_most, np.ones((len(frame), 1))]), axis=1)
        p_toxic = 1 - at_most[:, 0]
        yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "expected_severity": (1 - at_most).sum(axis=1),
                            "grade": mass.argmax(axis=1).astype(np.int32), "p_toxic": p_toxic, "toxic": p_toxic >= CALL_FROM})


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS) -> DataFrame:
    """Expected severity, likeliest grade and the toxic verdict of each document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(spark, texts, labels, max_labelled=max_labelled, max_words=max_words)
    return texts.select("doc_id", lower_az(F.col("text")).alias("text")).mapInPandas(lambda it: _score(it, model), _RESULT)
