"""Language identification: family first, then one-versus-one linear support vector machines inside the family.

Features are shares of hashed byte pairs and triples of the lower-cased text,
in which all but letters read as blanks. Languages whose mean features are
closer than the average pair form a family. A one-versus-rest machine for each
family picks the family; inside it every pair of languages has a machine of its
own, and the language with most votes wins (then the larger sum of margins,
then the name).

The fit uses a bounded sample (``PER_LANGUAGE`` documents of each language,
``TOTAL`` in all, chosen by a hash of the id). Prediction is one pass without a
shuffle, over whole texts, in which language, source and id play no part.

Nulls and texts without a letter: ``und`` with score 0. Rows without a
language are not learned from. Without any language to learn, every text is
``und``. Repeated rows are predicted each. Columns that have the name of a
result give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.arrow import annotated, blocks, buffers, remainder, text_of
from gridloom.llm.learning import first_of, platt, sigmoid

PER_LANGUAGE, TOTAL = 700, 5000
TRIPLES, DOUBLES = 3072, 1024
LETTER = np.full(256, 32, np.uint8)
LETTER[97:123], LETTER[128:] = np.arange(97, 123), np.arange(128, 256)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all triples, then pairs, of a block; and each text's bounds, a row for triples and one for pairs."""
    raw, at = buffers(text_of(pc.utf8_lower(texts)))
    # A blank before and after each text, so that no gram lies over two texts' letters.
    data = np.full(len(raw) + 2 * (len(at) - 1), 32, np.uint8)
    begin = at[:-1] + 2 * np.arange(len(at) - 1) + 1
    data[np.arange(len(raw)) + np.repeat(2 * np.arange(len(at) - 1) + 1, np.diff(at))] = LETTER[raw]
    wide = data.astype(np.uint32)
    two = wide[:-1] * np.uint32(257) + wide[1:] if len(wide) else wide
    three = two[:-1] * np.uint32(263) + wide[2:] if len(wide) > 2 else wide[:0]
    spread = lambda c, n: ((c * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(n)
    codes = np.concatenate([spread(three, TRIPLES), spread(two, DOUBLES) + np.uint32(TRIPLES)]).astype(np.int64)
    first, size = begin - 1, np.diff(at)
    bounds = np.array([[first, first + size], [first + len(three), first + len(three) + size + 1]])
    return codes, bounds


def shares(texts: pa.Array) -> np.ndarray:
    """Dense features of few texts."""
    codes, bounds = grams(texts)
    out = np.zeros((len(texts), TRIPLES + DOUBLES), np.float32)
    for i in range(len(texts)):
        for begin, end in bounds[:, :, i]:
            own = np.bincount(codes[begin:end], minlength=out.shape[1])
            out[i] += own / max(end - begin, 1)
    return out


def machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge, by accelerated descent; y is 1 or -1. Classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    mean = x.mean(axis=0)
    z = x - mean
    step = 1 / (2 * float((z**2).sum(axis=1).max(initial=1e-9)) + 2 + penalty)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, c = w.copy(), b
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ v + c)) * weight * y
        w2, b2 = v - step * (penalty * v - 2 * (slack @ z)), c + step * 2 * float(slack.sum())
        move = k / (k + 3)
        v, c = w2 + move * (w2 - w), b2 + move * (b2 - b)
        w, b = w2, b2
    return w, b - float(mean @ w)


def families(centres: np.ndarray) -> list[list[int]]:
    """Languages joined by average similarity of centres while it is above the mean of all pairs."""
    groups = [[i] for i in range(len(centres))]
    if len(groups) < 3:
        return groups if len(groups) < 2 else [[0, 1]]
    z = centres - centres.mean(axis=0)
    z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    like = z @ z.T
    limit = (like.sum() - np.trace(like)) / (len(z) * (len(z) - 1))
    while len(groups) > 2:
        best, a, b = max((like[np.ix_(p, q)].mean(), i, j) for (i, p), (j, q) in combinations(enumerate(groups), 2))
        if best <= limit:
            break
        groups[a] = sorted(groups[a] + groups.pop(b))
    return groups


@dataclass
class Languages:
    """names; families of their numbers; machines as columns of weights: families first, then pairs."""

    names: list[str]
    families: list[list[int]]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    offsets: np.ndarray
    scales: np.ndarray  # slope and intercept of each machine

    def margins(self, texts: pa.Array) -> np.ndarray:
        codes, bounds = grams(texts)
        out = np.empty((len(texts), len(self.offsets)))
        for j in range(len(self.offsets)):
            sums = np.append(0, np.cumsum(self.weights[codes, j], dtype=np.float64))
            out[:, j] = sum((sums[b[1]] - sums[b[0]]) / np.maximum(b[1] - b[0], 1) for b in bounds) + self.offsets[j]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        margins = self.margins(texts)
        chance = sigmoid(margins * self.scales[:, 0] + self.scales[:, 1])
        n = len(self.families)
        family = margins[:, :n].argmax(axis=1) if n > 1 else np.zeros(len(texts), np.int64)
        sure = chance[np.arange(len(texts)), family] if n > 1 else np.ones(len(texts))
        names, scores = [], []
        for i, text in enumerate(texts.to_pylist()):
            if not any(map(str.isalpha, text)):
                names.append("und")
                scores.append(0.0)
                continue
            members = self.families[family[i]]
            votes = {m: [0, 0.0, 1.0] for m in members}
            for j, (a, b) in enumerate(self.pairs, n):
                if a in votes:
                    m, p = margins[i, j], chance[i, j]
                    votes[a if m >= 0 else b][0] += 1
                    votes[a][1] += m
                    votes[b][1] -= m
                    votes[a][2] = min(votes[a][2], p)
                    votes[b][2] = min(votes[b][2], 1 - p)
            best = max(members, key=lambda m: (votes[m][0], votes[m][1], -m))
            names.append(self.names[best])
            scores.append(float(sure[i] * votes[best][2]))
        return names, scores


def fit(x: np.ndarray, lang: list[str]) -> Languages:
    names = sorted(set(lang))
    y = np.array([names.index(v) for v in lang], np.int64)
    if not names:
        return Languages([], [], [], np.zeros((TRIPLES + DOUBLES, 0)), np.zeros(0), np.zeros((0, 2)))
    stretch = (1 / np.sqrt(x.mean(axis=0) + 1e-4)).astype(np.float32)  # rare grams count for more
    z = x * stretch
    groups = families(np.array([z[y == k].mean(axis=0) for k in range(len(names))]))
    pairs = [p for g in groups for p in combinations(g, 2)]
    tasks = [(np.isin(y, g), np.ones(len(y), bool)) for g in groups] if len(groups) > 1 else [(np.ones(len(y), bool), np.ones(len(y), bool))]
    tasks += [(y == a, (y == a) | (y == b)) for a, b in pairs]
    found = []
    for positive, used in tasks:
        side = np.where(positive[used], 1, -1).astype(np.float32)
        w, b = machine(z[used], side)
        found.append((w * stretch, b, platt(z[used] @ w + b, (side > 0).astype(float))))
    return Languages(names, groups, pairs, np.column_stack([f[0] for f in found]), np.array([f[1] for f in found]), np.array([f[2] for f in found]))


def learn(documents: DataFrame, folds: int = 3, held: int = 1) -> Languages:
    """From text and language of a bounded sample outside the held-out fold."""
    known = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return fit(np.zeros((0, TRIPLES + DOUBLES), np.float32), [])
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, 1e6 * min(1.0, min(PER_LANGUAGE, TOTAL / len(counts)) / n))])
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) <= share[F.col("lang")])
    some = some.select("doc_id", "text", "lang")

    def run(batches):
        for block in blocks(batches, "text", 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in shares(text_of(block.column("text")))], pa.binary()), block.column("lang"), block.column("doc_id")], ["x", "lang", "doc_id"])

    features = some.mapInArrow(run, T.StructType.fromDDL("x binary, lang string").add(some.schema["doc_id"]))
    rows = first_of(features, TOTAL + TOTAL // 5).toLocalIterator()
    x, lang = [], []
    for r in rows:
        x.append(np.frombuffer(r.x, np.float32))
        lang.append(r.lang)
    return fit(np.array(x, np.float32).reshape(len(x), TRIPLES + DOUBLES), lang)


def identify(documents: DataFrame, model: Languages, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """documents with lang_pred and score."""
    def make():
        def of(block: pa.RecordBatch) -> list[pa.Array]:
            names, scores = model.predict(text_of(block.column(text)))
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return of

    return annotated(documents, text, "lang_pred string, score double", make, keep)
