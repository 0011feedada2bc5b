"""Toxicity: the likelihood and its gradient by brute force, chosen terms, small corpora."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import toxicity
from gridloom.llm.arrow import text_of


def brute_likelihood(p, x, grade, penalty):
    n = len(x[0])
    theta = [p[n]]
    for g in p[n + 1 :]:
        theta.append(theta[-1] + math.exp(g))
    total = -penalty / 2 * sum(w * w for w in p[:n])
    for features, k in zip(x, grade):
        z = sum(w * v for w, v in zip(p, features))
        above = [1.0, *(1 / (1 + math.exp(t - z)) for t in theta), 0.0]
        total += math.log(above[k] - above[k + 1])
    return total


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_likelihood_and_gradient(levels):
    rng = np.random.default_rng(levels)
    dense = rng.random((30, 4)) * (rng.random((30, 4)) < 0.6)
    grade = rng.integers(0, levels + 1, 30)
    row, column = np.nonzero(dense)
    x = toxicity.Sparse(row, column, dense[row, column], dense.shape)
    p = rng.normal(size=4 + levels) * 0.7
    value, slope = toxicity.likelihood(p, x, grade, 0.3)
    assert value == pytest.approx(brute_likelihood(list(p), dense.tolist(), grade.tolist(), 0.3))
    for k in range(len(p)):
        step = np.zeros(len(p))
        step[k] = 1e-6
        up, down = (brute_likelihood(list(p + s * step), dense.tolist(), grade.tolist(), 0.3) for s in (1, -1))
        assert slope[k] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_best_cut():
    chance = np.array([0.9, 0.8, 0.8, 0.3, 0.1])
    assert toxicity.best_cut(chance, np.array([1.0, 1, 1, 0, 0])) == pytest.approx(0.55)
    assert toxicity.best_cut(chance, np.array([1.0, 0, 1, 0, 0])) == pytest.approx(0.55)  # equal chances stay together
    assert toxicity.best_cut(chance, np.ones(5)) == pytest.approx(0.1)


def test_terms_of_a_text():
    def names(text):
        _, h, n = toxicity.terms(text_of(pa.array([text])))
        return dict(zip(h.tolist(), n.tolist()))

    one, two = names("vollidiot"), names("Oberidiot, oberidiot idiot")
    assert len(one) == 3 and sorted(two.values()) == [1, 2, 2, 2]
    assert len(set(one) & set(two)) == 1  # the end that both share
    assert names("") == names(None) == {}


def test_small_corpora_and_compounds(spark):
    """A dozen toxic rows, each with an insult never seen whole elsewhere; clean rows of the same words."""
    rng = random.Random(4)
    common = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(150)]
    prose = lambda: " ".join(rng.choices(common, k=40))
    insult = lambda: "".join(rng.choices("mnopqrst", k=4)) + "trottel"
    rows = [(i, prose() + (f" {insult()} " + prose() if i % 8 == 0 else "")) for i in range(160)] + [(200, None), (201, ""), (3, prose()), (None, prose())]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(160)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.severities(docs, labels).collect()
    assert len(got) == len(rows)
    own = [r for r in got if r.doc_id is not None and r.doc_id < 160]
    assert sum(r.predicted for r in own if r.doc_id % 8 == 0) >= 18  # of 20
    assert sum(r.predicted for r in own if r.doc_id % 8) <= 4  # of 141
    assert all(0 <= r.score <= 1 and r.score <= r.severity <= toxicity.GRADES * r.score + 1e-9 for r in got)
    mean = lambda toxic: np.mean([r.severity for r in own if (r.doc_id % 8 == 0) == toxic])
    assert mean(True) > 10 * mean(False)


def test_terms_are_chosen_by_their_tie(spark):
    rows = [([1, 2, -5], 1), ([1, 3, -5], 1), ([2, 3], 0), ([2, 9], 0), ([3, 2], 0)]
    sample = spark.createDataFrame(rows, "h array<int>, y int")
    got = toxicity.telling(sample)
    assert got.tolist() == sorted(np.array([1, 2, 3, -5], np.int32).view(np.uint32).tolist())  # 9 is in one row only
    assert toxicity.telling(sample.limit(0)).tolist() == []
