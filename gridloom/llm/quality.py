"""Quality classifier: regularised quadratic discriminant over statistics of a document.

Statistics of whole texts (lengths, shares of kinds of characters, repetition
of words) are transformed so that their classes look more like normal
distributions. Each class has a mean and a covariance shrunk towards the pooled
one and towards a multiple of the identity; its Cholesky factor is kept. The
score is the difference of the two Mahalanobis log densities, calibrated to a
probability on the training rows.

The fit uses a bounded sample of labelled rows (``learning.SAMPLE``); scoring
is one pass over all rows without a shuffle.

Nulls: a null text is empty; an empty text has all statistics 0 and is scored
like any other. With one class of labels, or none, every score is that class's
share (1 without labels). Repeated rows are scored each. Columns that have the
name of a result give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.arrow import annotated, blocks, buffers, remainder, text_of
from gridloom.llm.learning import first_of, labelled_sample, platt, sigmoid
from gridloom.llm.words import GRAPHIC, mix, words

#: Byte classes, one bit each.
UPPER, LOWER, DIGIT, SENTENCE, SYMBOL, BAR, SHOUT, WIDE = (1 << k for k in range(8))
CLASS = np.zeros(256, np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:] = UPPER, LOWER, DIGIT, WIDE
CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = SYMBOL
CLASS[[ord("."), ord(","), ord(";"), ord(":"), ord("?"), ord("'"), ord('"'), ord("-")]] = SENTENCE
CLASS[ord("|")], CLASS[ord("!")] = BAR, SHOUT
FEATURES = 15


def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(values, dtype=np.int64))
    return np.diff(sums[at])


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics per text."""
    raw, at = buffers(texts)
    size = np.maximum(np.diff(at), 1)
    kinds = CLASS[raw]
    share = {k: per_row(kinds & k > 0, at) for k in (UPPER, LOWER, DIGIT, SENTENCE, SYMBOL, BAR, SHOUT, WIDE)}
    w = words(texts, GRAPHIC)
    n = np.diff(w.first)
    count = np.maximum(n, 1)
    length = w.end - w.begin
    same = np.append(False, (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])) if len(w.hash) else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        tagged = np.unique(mix(w.hash + w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(w.row[tagged], minlength=len(n))
    last = kinds[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    marked = per_row(last & (SYMBOL | SHOUT | BAR) > 0, w.first)
    lines = per_row(raw == 10, at)
    mean = per_row(length, w.first) / count
    spread = np.sqrt(np.maximum(per_row(length.astype(np.int64) ** 2, w.first) / count - mean**2, 0))
    letters = np.maximum(share[UPPER] + share[LOWER], 1)
    return np.column_stack([
        np.log1p(n), np.sqrt(mean), np.log1p(spread), np.sqrt(share[UPPER] / letters), np.sqrt(share[DIGIT] / size), np.sqrt(share[SENTENCE] / size),
        np.sqrt(share[SYMBOL] / size), np.sqrt(share[BAR] / size), np.sqrt(share[SHOUT] / size), np.sqrt(share[WIDE] / size), np.sqrt(per_row(same, w.first) / count),
        np.log1p(distinct) / np.log1p(count), np.sqrt(marked / count), np.sqrt(lines / count), np.log1p(distinct),
    ])


@dataclass
class Discriminant:
    """Two classes with means, the cached inverses of their Cholesky factors and log determinants; and the calibration."""

    means: np.ndarray
    inverses: np.ndarray
    constants: np.ndarray
    slope: float
    intercept: float
    fixed: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        density = []
        for mean, inverse, constant in zip(self.means, self.inverses, self.constants):
            z = inverse @ (x - mean).T
            density.append(constant - 0.5 * (z**2).sum(axis=0))
        return squashed(density[1] - density[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        return sigmoid(self.slope * self.raw(x) + self.intercept)


def squashed(d: np.ndarray) -> np.ndarray:
    """Log-density differences grow with the square of a distance; their signed root keeps order and tames tails."""
    return np.sign(d) * np.sqrt(np.abs(d))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = 0.1, identity: float = 0.01) -> Discriminant:
    if len(y) == 0 or y.min() == y.max():
        return Discriminant(np.zeros(0), np.zeros(0), np.zeros(0), 1, 0, float(y.mean()) if len(y) else 1.0)
    groups = [x[y == k] for k in (0, 1)]
    means = np.array([g.mean(axis=0) for g in groups])
    whole = sum((g - m).T @ (g - m) for g, m in zip(groups, means)) / len(y)
    factors, constants = [], []
    for g, m in zip(groups, means):
        own = (g - m).T @ (g - m) / len(g)
        cov = (1 - pooled - identity) * own + pooled * whole + identity * np.trace(whole) / len(m) * np.eye(len(m)) + 1e-9 * np.eye(len(m))
        factors.append(np.linalg.cholesky(cov))
        constants.append(np.log(len(g) / len(y)) - np.log(np.diag(factors[-1])).sum())
    model = Discriminant(means, np.linalg.inv(np.array(factors)), np.array(constants), 1, 0)
    model.slope, model.intercept = platt(model.raw(x), y)
    return model


def train(documents: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 5) -> Discriminant:
    """Fitted on the labelled sample outside the held-out fold."""
    sample = labelled_sample(documents, labels, target, remainder("doc_id", folds) != 0)

    def run(batches):
        for block in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(list(statistics(text_of(block.column("text")))), pa.list_(pa.float64())), block.column("y"), block.column("doc_id")], ["x", "y", "doc_id"])

    rows = first_of(sample.mapInArrow(run, T.StructType.fromDDL("x array<double>, y int").add(sample.schema["doc_id"]))).collect()  # SAMPLE rows at most
    return fit(np.array([r.x for r in rows]).reshape(len(rows), FEATURES), np.array([r.y for r in rows], float))


def score_quality(df: DataFrame, model: Discriminant, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with ``score``, 0 to 1."""
    return annotated(df, text, "score double", lambda: lambda block: [pa.array(model.score(statistics(text_of(block.column(text)))))], keep)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score_quality(documents, train(documents, labels), keep=["doc_id"])
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns."""
    model = train(documents, labels)

    def run(batches):
        for block in blocks(batches, "text"):
            yield block.filter(pa.array(model.score(statistics(text_of(block.column("text")))) >= threshold))

    return documents.mapInArrow(run, documents.schema)
