"""Quality scores by co-training: the text's content and the page's metadata teach each other.

Two views describe a document: its content (how its words repeat, which kinds of characters they
have) and its metadata (language, source, size and layout of lines). Each has its own logistic classifier. In every round each
classifier labels the documents it is surest of in a pool without labels, and the other one learns from
them. Held-out labels calibrate both and weigh them in the combined score.

Bounds: ``max_labelled`` labelled and ``pool`` unlabelled documents, both in hash order of the id, are used for fitting; what
reaches the driver is one short vector for each of them. All documents are scored by one pass over their whole texts.

Defined results: null text is empty; a null language or source is a value of its own; rows with the same id are separate rows;
without labels of both kinds every document scores 0.5 and is kept; an empty table gives no rows. Only the id,
text, language and source columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.text import saved

MAX_LABELLED = 8_000
POOL = 8_000
ROUNDS = 3
SURE = 0.95
PER_ROUND = 1_000  # pseudo-labels of each kind that a view gives in a round
KEEP_FROM = 0.5
_BLANKS = " \t\n\x0b\x0c\r"
_WORD = re.compile("[^\x20\x09-\x0d]+")
_HASHED = 16  # columns for the language, and as many for the source
N_CONTENT, N_METADATA = 10, 6 + 2 * _HASHED


def content(text: str) -> list[float]:
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * (N_CONTENT - 1) + [1.0]
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    letters = raw[65:91].sum() + raw[97:123].sum() + raw[128:].sum() / 2
    symbols = raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()
    heavy = sum(raw[ord(c)] for c in "#*$%&|<>!")
    pairs = len(set(zip(words, words[1:])))
    return [np.log1p(n), len(set(words)) / n, pairs / max(n - 1, 1), sum(map(len, words)) / n / 10, letters / raw.sum(),
            raw[65:91].sum() / max(letters, 1), symbols / n, min(heavy / n, 3.0), raw[48:58].sum() / n, 0.0]


def metadata(text: str, lang: str | None, source: str | None) -> list[float]:
    lines = text.split("\n")
    sizes = np.array([len(line) for line in lines], dtype=float)
    out = [np.log1p(len(text)), np.log1p(len(lines)), np.log1p(sizes.mean()), np.log1p(sizes.std()),
           len(set(lines)) / len(lines), float((sizes == 0).mean())]
    for value in (lang, source):
        column = [0.0] * _HASHED
        column[zlib.crc32(("" if value is None else f"={value}").encode()) % _HASHED] = 1.0
        out += column
    return out


@dataclass(frozen=True)
class View:
    """A classifier over standardised features, with the line that calibrates its score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return self.slope * (np.hstack([z, z**2, np.ones((len(z), 1))]) @ self.weights) + self.offset


@dataclass(frozen=True)
class CoTrained:
    content: View
    metadata: View
    combined: np.ndarray  # weight of either view's logit, and a constant

    def scores(self, content_x: np.ndarray, metadata_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content.logit(content_x), self.metadata.logit(metadata_x)
        return _sigmoid(a), _sigmoid(b), _sigmoid(np.stack([a, b, np.ones(len(a))], axis=1) @ self.combined)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, target: np.ndarray | None = None) -> np.ndarray:
    """Newton steps; the ridge pulls towards ``target`` (zero if not given)."""
    weights = np.zeros(x.shape[1])
    home = weights if target is None else target
    for _ in range(30):
        p = _sigmoid(x @ weights)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty * np.eye(x.shape[1]),
                               x.T @ (p - y) / len(x) + penalty * (weights - home))
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _view(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    return View(mean, scale, _logistic(np.hstack([z, z**2, np.ones((len(z), 1))]), y))


def _calibrated(view: View, x: np.ndarray, y: np.ndarray) -> View:
    logits = view.logit(x)
    slope, offset = _logistic(np.stack([logits, np.ones(len(x))], axis=1), y, 1e-3, np.array([1.0, 0.0]))
    return View(view.mean, view.scale, view.weights, float(slope), float(offset))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS,
             sure: float = SURE, per_round: int = PER_ROUND) -> CoTrained:
    """A quarter of the labels is held out for calibration; pseudo-labels never enter it."""
    held = np.arange(len(y)) % 4 == 3
    taught: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0)) for _ in views]
    free = [np.ones(len(pool[0]), bool) for _ in views]

    def fitted(v: int) -> View:
        at, labels = taught[v]
        return _view(np.vstack([views[v][~held], pool[v][at]]), np.concatenate([y[~held], labels]))

    for _ in range(rounds):
        lessons = []
        for v in range(2):
            p = _sigmoid(fitted(v).logit(pool[v])) if len(pool[v]) else np.zeros(0)
            pupil = 1 - v
            good = np.argsort(-p, kind="stable")[:per_round]
            bad = np.argsort(p, kind="stable")[:per_round]
            good = good[(p[good] >= sure) & free[pupil][good]]
            bad = bad[(p[bad] <= 1 - sure) & free[pupil][bad]]
            lessons.append((pupil, np.concatenate((good, bad)), np.concatenate((np.ones(len(good)), np.zeros(len(bad))))))
        for pupil, at, labels in lessons:
            free[pupil][at] = False
            taught[pupil] = (np.concatenate((taught[pupil][0], at)), np.concatenate((taught[pupil][1], labels)))
    a, b = (_calibrated(fitted(v), views[v][held], y[held]) for v in range(2))
    logits = np.stack([a.logit(views[0][held]), b.logit(views[1][held]), np.ones(held.sum())], axis=1)
    return CoTrained(a, b, _logistic(logits, y[held], 1e-2, np.array([0.5, 0.5, 0.0])))


def _vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = [t or "" for t in frame["text"]]
        yield pd.DataFrame({"doc_id": frame["doc_id"], "quality": frame["quality"], "content": [content(t) for t in texts],
                            "metadata": [metadata(*x) for x in zip(texts, frame["lang"], frame["source"])]})


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, pool: int = POOL) -> CoTrained | None:
    """``docs``: doc_id, text, lang, source; ``labels``: doc_id, quality (0 or 1). None if one kind of label is missing."""
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").cast("double").alias("quality"))
    chosen = known.orderBy(*order).limit(max_labelled)
    unknown = (docs.select("doc_id").filter("doc_id is not null").join(known, "doc_id", "left_anti").distinct()
               .orderBy(*order).limit(pool).withColumn("quality", F.lit(None).cast("double")))
    sample = saved(chosen.unionByName(unknown), spark, "quality-sample")
    rows = (docs.join(sample, "doc_id").select("doc_id", "text", "lang", "source", "quality").dropDuplicates(["doc_id"])
            .mapInPandas(_vectors, "doc_id long, quality double, content array<double>, metadata array<double>")
            .orderBy(*order).collect())
    with_label = [r for r in rows if r["quality"] is not None]
    y = np.array([r["quality"] for r in with_label])
    if len(with_label) < 8 or y.min() == y.max() or y[np.arange(len(y)) % 4 == 3].std() == 0:
        return None
    without = [r for r in rows if r["quality"] is None]

    def matrix(rows_: list, name: str, width: int) -> np.ndarray:
        return np.array([r[name] for r in rows_], dtype=float).reshape(-1, width)

    sizes = (("content", N_CONTENT), ("metadata", N_METADATA))
    return co_train(tuple(matrix(with_label, *s) for s in sizes), y, tuple(matrix(without, *s) for s in sizes))


_RESULT = "doc_id long, content_score double, metadata_score double, score double, kept boolean"


def _scored(frames: Iterator[pd.DataFrame], model: CoTrained | None, keep_from: float) -> Iterator[pd.DataFrame]:
    for frame in frames:
        a = b = both = np.full(len(frame), 0.5)
        if model is not None and len(frame):
            texts = [t or "" for t in frame["text"]]
            a, b, both = model.scores(np.array([content(t) for t in texts]),
                                      np.array([metadata(*x) for x in zip(texts, frame["lang"], frame["source"])]))
        yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "content_score": a, "metadata_score": b, "score": both,
                            "kept": both >= keep_from})


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source", max_labelled: int = MAX_LABELLED, pool: int = POOL,
          keep_from: float = KEEP_FROM) -> DataFrame:
    """The score of either view, the combined score and the verdict for each document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                        F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    model = fit(spark, texts, labels, max_labelled=max_labelled, pool=pool)
    return texts.mapInPandas(lambda it: _scored(it, model, keep_from), _RESULT)
