"""Bounded samples of labelled rows, and small fits in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier learns from at most, chosen by a hash of their id.
SAMPLE = 12_000


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, train, limit: int = SAMPLE) -> DataFrame:
    """doc_id, text and label ``y`` of documents with one of ``limit`` ids, by hash of the id. Null labels and ids don't count; of several labels the largest holds.

    Rows stay where they are: make features of them, then take ``first_of`` these, so that texts never meet in one task.
    """
    own = labels.filter(train & F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    some = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return documents.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def first_of(features: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """At most ``limit`` feature rows (an id may have several documents), by hash of the id."""
    return features.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).drop("doc_id")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def platt(raw: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept that turn raw scores into probabilities.

    Targets are drawn in from 0 and 1 by the classes' sizes, so that classes which
    a threshold separates have a finite best slope; a Newton step that doesn't
    lower the loss is halved.
    """
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    many = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y > 0, (many[0] + 1) / (many[0] + 2), 1 / (many[1] + 2))
    unit = float(raw.std()) or 1.0
    x = np.column_stack([raw / unit, np.ones(len(raw))])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - target * z).sum() + 5e-7 * (w @ w))

    w = np.array([0.0, np.log((many[0] + 1) / (many[1] + 1))])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (p - target) + 1e-6 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), slope)
        now, size = loss(w), 1.0
        while size > 1e-6 and loss(w - size * step) > now - 1e-4 * size * float(slope @ step):
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-9:
            break
        w = w - size * step
    return float(max(w[0], 1e-6) / unit), float(w[1])
