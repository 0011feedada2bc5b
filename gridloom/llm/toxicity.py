"""Toxicity: cumulative-link ordinal regression on sparse text features.

Grades are 0 (not toxic) to ``GRADES``. Labels only say toxic or not, so toxic
training rows are graded by how surely other rows mark them: each row gets its
chance from a fit on the folds that it isn't in, and these chances are cut at
equal shares. Equal chances have equal grades; grades that no row has are left
out, so few toxic rows give fewer grades.

The model has one weight per term, shared by all thresholds: the chance of a
grade above k is the logistic function of (terms' weights - threshold k), with
ascending thresholds. The output is the expected severity, the sum of these
chances. A row is predicted toxic from the chance on that has the best F-score
on the training rows, with chances from the folds that a row isn't in.

Terms are words, and the first and last ``AFFIX`` bytes of longer words (for
compounds). Their features are the logarithms of their counts. The ``TERMS``
terms most tied to the label are kept, whatever their number of rows but one;
the penalty on weights, no fixed cut, keeps chance ones small. The fit uses a
bounded sample of labelled rows (``learning.SAMPLE``), whose terms are counted by
Spark; scoring is one pass without a shuffle.

Nulls: a null text is empty and has only the thresholds' severity. With one
class of labels, or none, every severity is 0 or the highest. Repeated rows are
scored each. Columns that have the name of a result give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.arrow import annotated, blocks, partitions, remainder, stored, text_of
from gridloom.llm.learning import first_of, labelled_sample, sigmoid
from gridloom.llm.words import mix, words

GRADES, TERMS, FOLDS = 3, 2000, 3
AFFIX = 5  # bytes of a word's begin and end


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and 32-bit hash of every term of each text, as they come."""
    w = words(texts)
    long = w.end - w.begin > AFFIX
    padded = np.append(w.data, np.zeros(AFFIX, np.uint8))

    def affix(at: np.ndarray, tag: int) -> np.ndarray:
        packed = np.full(len(at), tag, np.uint64)
        for k in range(AFFIX):
            packed = packed << np.uint64(8) | padded[at + k].astype(np.uint64)
        return mix(packed)

    h = np.concatenate([w.hash, affix(w.begin[long], 1), affix(w.end[long] - AFFIX, 2)])
    return np.concatenate([w.row, w.row[long], w.row[long]]), (h >> np.uint64(32)).astype(np.uint32)


def counted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct term of each row."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))) if len(row) else np.zeros(0, np.int64)
    return row[new], h[new], np.diff(np.append(new, len(row)))


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return counted(*occurrences(texts))


@dataclass
class Ordinal:
    vocabulary: np.ndarray  # hashes, ascending
    weights: np.ndarray
    thresholds: np.ndarray
    toxic_from: float = 0.5  # chance from which a row is predicted toxic

    def known(self, h: np.ndarray) -> np.ndarray:
        """Which hashes are in the vocabulary; a table of their upper halves decides most."""
        upper = np.zeros(1 << 16, bool)
        upper[self.vocabulary >> 16] = True
        maybe = upper[h >> 16]
        maybe[maybe] = np.isin(h[maybe], self.vocabulary)
        return maybe

    def chances(self, row: np.ndarray, h: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
        """Chance of a grade above 0, 1, ... for each row."""
        held = self.known(h)
        at = np.searchsorted(self.vocabulary, h[held])
        value = np.bincount(row[held], self.weights[at] * np.log1p(count[held]), rows) if held.any() else np.zeros(rows)
        return sigmoid(value[:, None] - self.thresholds[None, :])

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        row, h = occurrences(texts)
        held = self.known(h)
        return self.chances(*counted(row[held], h[held]), len(texts))


@dataclass
class Sparse:
    """Features as (row, column, value)."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.shape[1])

    def of(self, rows: np.ndarray) -> Sparse:
        """The rows where ``rows`` is true."""
        here, number = rows[self.row], np.cumsum(rows) - 1
        return Sparse(number[self.row[here]], self.column[here], self.value[here], (int(rows.sum()), self.shape[1]))


def thresholds_of(p: np.ndarray, n: int) -> np.ndarray:
    return p[n] + np.append(0, np.cumsum(np.exp(p[n + 1 :])))


def likelihood(p: np.ndarray, x: Sparse, grade: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Penalised log likelihood and its gradient by weights, first threshold and logarithms of the gaps to the next ones."""
    n, i = x.shape[1], np.arange(len(grade))
    theta = thresholds_of(p, n)
    z = x.times(p[:n])
    above = np.column_stack([np.ones(len(z)), sigmoid(z[:, None] - theta[None, :]), np.zeros(len(z))])
    chance = np.maximum(above[i, grade] - above[i, grade + 1], 1e-12)
    slope = above * (1 - above)
    upper, lower = slope[i, grade] / chance, slope[i, grade + 1] / chance
    levels = len(theta)
    by_theta = np.bincount(grade, lower, levels + 1)[:levels] - np.bincount(grade, upper, levels + 1)[1:]
    later = by_theta[::-1].cumsum()[::-1]
    slopes = np.concatenate([x.back(upper - lower) - penalty * p[:n], later[:1], later[1:] * np.exp(p[n + 1 :])])
    return float(np.log(chance).sum() - penalty / 2 * (p[:n] @ p[:n])), slopes


def fit_ordinal(x: Sparse, grade: np.ndarray, penalty: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ascending thresholds, by ascent on the penalised likelihood (Adam steps)."""
    n = x.shape[1]
    share = np.array([((grade > k).sum() + 0.5) / (len(grade) + 1) for k in range(max(int(grade.max(initial=0)), 1))])
    gaps = np.log((1 - share) / share)
    p = np.concatenate([np.zeros(n), gaps[:1], np.log(np.maximum(np.diff(gaps), 0.1))])
    m, s = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        g = likelihood(p, x, grade, penalty)[1]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        p = p + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return p[:n], thresholds_of(p, n)


def left_out(x: Sparse, grade: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Each row's chance of a grade above 0, from a fit on the other folds."""
    out = np.zeros(len(grade))
    for k in range(FOLDS):
        weights, thresholds = fit_ordinal(x.of(fold != k), grade[fold != k])
        out[fold == k] = sigmoid(x.of(fold == k).times(weights) - thresholds[0])
    return out


def best_cut(chance: np.ndarray, y: np.ndarray) -> float:
    """Where the F-score of ``chance >= cut`` is best; between two chances."""
    order = np.argsort(-chance, kind="stable")
    ranked = chance[order]
    score = 2 * np.cumsum(y[order]) / (np.arange(1, len(y) + 1) + y.sum())
    score[:-1][ranked[:-1] == ranked[1:]] = -1.0  # equal chances are on one side
    k = int(score.argmax())
    return float((ranked[k] + ranked[k + 1]) / 2 if k + 1 < len(y) else ranked[k])


def fit(samples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Ordinal:
    """samples: hashes and counts of each training text's terms; y: toxic or not."""
    if len(y) == 0 or y.min() == y.max():
        return Ordinal(np.zeros(0, np.uint32), np.zeros(0), np.full(GRADES, -60.0 if len(y) and y.max() else 60.0))
    row = np.repeat(np.arange(len(samples)), [len(h) for h, _ in samples])
    known, number = np.unique(np.concatenate([h for h, _ in samples]), return_inverse=True)
    x = Sparse(row, number, np.log1p(np.concatenate([c for _, c in samples])), (len(samples), len(known)))
    fold = np.zeros(len(y), np.int64)
    for k in (0, 1):
        fold[y == k] = np.arange((y == k).sum()) % FOLDS
    chance = left_out(x, y.astype(np.int64), fold)
    cuts = np.quantile(chance[y == 1], np.arange(1, GRADES) / GRADES)
    grade = np.unique(np.where(y == 1, 1 + np.searchsorted(cuts, chance, "left"), 0), return_inverse=True)[1]
    return Ordinal(known, *fit_ordinal(x, grade), best_cut(left_out(x, grade, fold), y))


def telling(sample: DataFrame) -> np.ndarray:
    """Hashes of the at most TERMS terms most tied to the label, of rows (h array, y)."""
    rows, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = toxic / rows if rows else 0.0
    spread = F.sqrt(F.col("held") * share * (1 - share) + 1)
    counts = sample.select(F.explode("h").alias("term"), "y").groupBy("term").agg(F.count("*").alias("held"), F.sum("y").alias("toxic"))
    tie = F.abs((F.col("toxic") - F.col("held") * share) / spread)
    first = counts.filter("held > 1").orderBy(tie.desc(), "term").limit(TERMS).select("term").collect()  # TERMS rows at most
    return np.sort(np.array([r.term for r in first], np.int32).view(np.uint32))


def train(documents: DataFrame, labels: DataFrame, folds: int = 5) -> Ordinal:
    sample = labelled_sample(documents, labels, "toxic", remainder("doc_id", folds) != 0)
    spark = documents.sparkSession

    def run(batches):
        for block in blocks(batches, "text"):
            row, h, count = terms(text_of(block.column("text")))
            at = pa.array(np.searchsorted(row, np.arange(block.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (h.view(np.int32), count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*lists, block.column("y"), block.column("doc_id")], ["h", "n", "y", "doc_id"])

    made = first_of(sample.mapInArrow(run, T.StructType.fromDDL("h array<int>, n array<int>, y int").add(sample.schema["doc_id"])))
    made = stored(made.repartition(partitions(spark)), "toxicity-sample")
    kept = Ordinal(telling(made), np.zeros(0), np.zeros(0))

    def pick(batches):
        for batch in batches:
            pairs = []
            for h, n in zip(batch.column("h"), batch.column("n")):
                h, n = np.asarray(h.values).view(np.uint32), np.asarray(n.values)
                held = kept.known(h)
                pairs.append((h[held].tobytes(), n[held].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary()), batch.column("y")], ["h", "n", "y"])

    rows = made.mapInArrow(pick, "h binary, n binary, y int").collect()  # SAMPLE rows at most, of TERMS terms
    rows.sort(key=lambda r: (r.y, r.h, r.n))
    return fit([(np.frombuffer(r.h, np.uint32), np.frombuffer(r.n, np.int32)) for r in rows], np.array([r.y for r in rows], float))


def grade(documents: DataFrame, model: Ordinal, text: str = "text", keep: list[str] | None = None, threshold: float | None = None) -> DataFrame:
    """documents with score (chance of any toxicity), severity (expected grade), grade (likeliest), predicted (from ``threshold`` on, else the model's own)."""
    least = model.toxic_from if threshold is None else threshold

    def make():
        def of(block: pa.RecordBatch) -> list[pa.Array]:
            above = model.of_texts(text_of(block.column(text)))
            each = -np.diff(np.column_stack([np.ones(len(above)), above, np.zeros(len(above))]), axis=1)
            return [pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array((above[:, 0] >= least).astype(np.int32))]

        return of

    return annotated(documents, text, "score double, severity double, grade int, predicted int", make, keep)


def severities(documents: DataFrame, labels: DataFrame) -> DataFrame:
    graded = grade(documents, train(documents, labels), keep=["doc_id"])
    return graded.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "severity", "grade", "predicted")
