"""Vector operators against brute force: nulls, ties, repeated rows, other sizes, empty tables, clashing columns."""

import hashlib
import os
import random

import numpy as np
import pytest

from compare import connect, differences
from gridloom.llm import bit_codes, centroids, hard_negatives
from gridloom.llm.queries import QUERIES

KIND = "vec_id long, embedding array<float>, label int, size int, data string, cluster int"
FOLDERS = [f for f in ("/root/testdata/sf0.001", "/root/testdata/sf0.01") if os.path.isdir(f)]


@pytest.mark.parametrize("folder", FOLDERS)
@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_nearest", "op13_centroids"])
def test_queries_agree_with_sql(spark, folder, name):
    query, sql = QUERIES[name]
    assert differences(query(spark, folder), connect(folder), sql) == ""


def table(spark, dims, n=400, seed=5):
    """Vectors on a coarse lattice, so that scores and distances tie often; a hot label and a hot vector."""
    rng = random.Random(seed)
    vector = lambda: [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5]) for _ in range(dims)]
    hot = vector()
    rows = [(i, hot if rng.random() < 0.3 else vector(), 1 if rng.random() < 0.5 else rng.randrange(4)) for i in range(-200, n)]
    rows += [rows[3], rows[200], rows[200]]
    rows += [(1000, vector(), None), (None, vector(), 2), (1100, None, 1), (1200, [None] * dims, 1), (1300, [float("nan")] + [0.1] * (dims - 1), 1), (1400, [float("inf")] * dims, 2)]
    rows += [(1500, [0.0] * dims, 1), (1600, [0.25] * (dims + 1), 1), (1700, [0.5] * (dims + 1), 1), (1701, [0.4375] * (dims + 1), 3), (1800, [], 1), (1801, [], 1), (1802, [], 2), (1900, [float(np.float32(3e38))] * dims, 1)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(*r, 9, "mine", 5) for r in rows], KIND).repartition(5)


def whole(rows, scale):
    return [(i, np.floor(scale * np.array(v, float)), y) for i, v, y in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]


def test_hard_negatives(spark):
    rows, df = table(spark, 6)
    own = [r for r in whole(rows, 256) if r[2] is not None and len(r[1]) * (np.abs(r[1]).max(initial=0) + 1) ** 2 < 2**62]
    want = []
    for a, v, label in own:
        if a % 100:
            continue
        scored = sorted((-int(v @ w), i, y) for i, w, y in own if len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label and x[1] != a][:5]:
            near = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            want += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(near, 1)]
    got = hard_negatives.mine(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    anchors, block = rng.integers(-300, 300, (40, 9)), rng.integers(-300, 300, (500, 9))
    low, high = hard_negatives.bounds(anchors, block.min(axis=0)[None], block.max(axis=0)[None])
    scores = anchors @ block.T
    assert (low <= scores).all() and (scores <= high).all()
    large = np.full((2, 3), 2**29)
    assert hard_negatives.product(large, large)[0, 0] == 3 * 2**58


def test_curve_visits_every_cell_by_single_steps():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    place = hard_negatives.curve(cells, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_blocks_out_of_reach_are_not_read():
    """Two far apart blocks: the anchors of one need only that one for positives."""
    anchors, low, high = np.array([[100, 0]]), np.array([[90, -5], [-100, -5]]), np.array([[110, 5], [-90, 5]])
    _, most = hard_negatives.bounds(anchors, low, high)
    assert most.tolist() == [[11000, -9000]]


def test_nearest(spark):
    rows, df = table(spark, 6)
    exactly = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    want = []
    for q, v in exactly:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(np.cumsum((v - w) ** 2)[-1])), i) for i, w in exactly if len(w) == len(v) and i != q)[:10]
            want += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    got = bit_codes.nearest(df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert bit_codes.nearest(df.limit(0)).count() == 0


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(4)
    vectors, queries = rng.standard_normal((3000, 48)), rng.standard_normal((50, 48))
    turn = bit_codes.Turn(48, np.zeros(48))
    _, turned = turn(vectors)
    _, asked = turn(queries)
    codes, fits = bit_codes.coded(turned)
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    error = np.abs(bit_codes.estimates(asked, codes, fits) - unit(queries) @ unit(vectors).T)
    assert codes.shape == (3000, 32) and (error <= bit_codes.errors(fits, 256, 4.0)).mean() > 0.999
    assert (error <= bit_codes.errors(fits, 256, 1.0)).mean() < 0.9


def test_recall_on_clusters(spark):
    """Far from the origin, in tight groups: the mean is taken off, and the bounds still find the neighbours."""
    rng = np.random.default_rng(8)
    heads = rng.standard_normal((20, 64)) + 30
    points = heads[rng.integers(0, 20, 3000)] + 0.05 * rng.standard_normal((3000, 64))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for r in bit_codes.nearest(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 100):
        apart = np.linalg.norm(points - points[q], axis=1)
        apart[q] = np.inf
        hits += len(found[q] & set(np.argsort(apart)[:10].tolist()))
    assert hits >= 0.99 * 300


def test_walk_finds_the_nearest():
    rng = np.random.default_rng(6)
    for k, dims in [(1, 3), (5, 2), (16, 64), (40, 4)]:
        heads, vectors = rng.integers(-3, 4, (k, dims)), rng.integers(-4, 5, (700, dims))
        apart = ((vectors[:, None] - heads) ** 2).sum(axis=2)
        chosen, distance = centroids.Lists(heads).nearest(vectors)
        assert (chosen == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()


@pytest.mark.parametrize("dims, k", [(6, 16), (6, 2000)])
def test_clusters(spark, dims, k):
    rows, df = table(spark, dims)
    own = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x) < 2**27 for x in v)]
    marked = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", n) for n, (i, _) in enumerate(own))
    heads = np.array([own[n][1] for _, _, n in marked[:k]])
    vectors = np.array([v for _, v in own])
    near = lambda: ((vectors[:, None] - heads) ** 2).sum(axis=2)
    for _ in range(3):
        chosen = near().argmin(axis=1)
        for c in np.unique(chosen):
            heads[c] = vectors[chosen == c].sum(axis=0) // (chosen == c).sum()
    apart = near()
    chosen, distance = apart.argmin(axis=1), apart.min(axis=1)
    inertia = np.bincount(chosen, distance, len(heads)).astype(int)
    text = lambda c: hashlib.sha256(",".join(map(str, heads[c].tolist())).encode()).hexdigest()
    want = [(i, int(c), int(d), int(inertia[c]), int(distance.sum()), text(c)) for (i, _), c, d in zip(own, chosen, distance)]
    got = centroids.cluster(df, k=k, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert centroids.cluster(df.limit(0)).count() == 0
