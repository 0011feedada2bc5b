"""Rounds of centroid clustering, in which each vector finds its nearest centroid by the threshold algorithm.

Vectors are whole numbers: component x is floor(scale * x). For each dimension
the centroids are listed by their value. A vector walks every list outward from
its own value, one centroid a step in each list, and takes the exact distance
of each centroid that it meets for the first time. The gaps to the next ones of
all lists bound from below the distance of any centroid not yet met; the walk
ends when that bound strictly exceeds the best distance, so that a centroid of
equal distance and smaller number is never missed.

Only vectors with exactly ``dims`` components take part, none null or
non-finite, and none past 2**27 once scaled: squares of those would leave 64
bits. Repeated rows each count. A null id takes part like any other, and its
vector is a first centroid only after all others. Fewer vectors than centroids
give fewer centroids; no rows give no rows. Other columns play no part. Sums
are exact, so the result doesn't depend on how rows are dealt out; inertia
that passes 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrow import stored
from gridloom.llm.vectors import matrices, usable

LARGEST = 1 << 27
#: Vectors that walk together.
STEP = 2048


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * values).astype(np.int64)


class Lists:
    """The centroids of each dimension, by value."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.number = np.argsort(centroids, axis=0, kind="stable")
        self.value = np.take_along_axis(centroids, self.number, axis=0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each vector's nearest centroid (the smallest of several), and the squared distance."""
        n, (k, dims) = len(vectors), self.centroids.shape
        column = np.arange(dims)
        above = np.empty((n, dims), np.int64)  # the next centroid upward in each list; the one below it is the next downward
        for d in column:
            above[:, d] = np.searchsorted(self.value[:, d], vectors[:, d])
        below = above - 1
        seen = np.zeros((n, k), bool)
        best = np.full(n, np.iinfo(np.int64).max)
        chosen = np.zeros(n, np.int64)
        walking = np.arange(n)
        far = np.iinfo(np.int64).max

        def gaps(at: np.ndarray, own: np.ndarray) -> np.ndarray:
            inside = (at >= 0) & (at < k)
            gap = np.abs(own - self.value[np.clip(at, 0, k - 1), column])
            return np.where(inside, gap, far)

        while len(walking):
            own, up, down = vectors[walking], above[walking], below[walking]
            upward, downward = gaps(up, own), gaps(down, own)
            rise = upward < downward
            met = self.number[np.clip(np.where(rise, up, down), 0, k - 1), column]
            above[walking], below[walking] = np.where(rise, up + 1, up), np.where(rise, down, down - 1)
            now = np.zeros((len(walking), k), bool)
            now[np.arange(len(walking))[:, None], met] = True
            for c in range(k):  # ascending, and only a smaller distance is better: ties keep the smaller number unless it comes later
                fresh = np.flatnonzero(now[:, c] & ~seen[walking, c])
                if len(fresh):
                    row = walking[fresh]
                    distance = ((vectors[row] - self.centroids[c]) ** 2).sum(axis=1)
                    better = (distance < best[row]) | ((distance == best[row]) & (c < chosen[row]))
                    best[row[better]], chosen[row[better]] = distance[better], c
            seen[walking] |= now
            next_up, next_down = gaps(above[walking], own), gaps(below[walking], own)
            gap = np.minimum(next_up, next_down)
            ended = (gap == far).any(axis=1)  # a list is walked to its ends: every centroid has been met
            frontier = (np.where(ended[:, None], 0, gap) ** 2).sum(axis=1)
            walking = walking[~(ended | seen[walking].all(axis=1) | (frontier > best[walking]))]
        return chosen, best


def kept(df: DataFrame, key: str, vector: str, scale: int, dims: int) -> DataFrame:
    fits = F.forall(vector, lambda x: F.abs(F.floor(x.cast("double") * scale)) < LARGEST)
    small = F.forall(vector, lambda x: F.abs(x) < LARGEST)  # tested first: a larger one can't be cast
    return df.filter(F.when(usable(vector) & (F.size(vector) == dims), F.when(small, fits).otherwise(False)).otherwise(False)).select(F.col(key).alias("_key"), F.col(vector).alias("_vector"))


def first_centroids(rows: DataFrame, k: int, scale: int, seed: int = 1) -> np.ndarray:
    """The k vectors whose ids hash lowest; rows of equal id by their vector."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_key").cast("string")).cast("binary"), 256)
    some = rows.select(mark.alias("_mark"), "_vector").orderBy(F.col("_mark").asc_nulls_last(), "_vector").limit(k).collect()
    return scaled(np.array([r["_vector"] for r in some], float), scale) if some else np.zeros((0, 0), np.int64)


def sums(rows: DataFrame, centroids: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Component sums and counts of the vectors of each centroid: k x dims numbers, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, values in matrices(batch.column("_vector")):
                for i in range(0, len(values), STEP):
                    own = scaled(values[i : i + STEP], scale)
                    chosen, _ = lists.nearest(own)
                    for c in np.unique(chosen):
                        total[c] += own[chosen == c].sum(axis=0)
                    n += np.bincount(chosen, minlength=len(n))
        at, dim = np.nonzero(np.broadcast_to(n[:, None] > 0, total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(dim), pa.array(total[at, dim]), pa.array(n[at])], ["c", "d", "total", "n"])

    parts = rows.select("_vector").mapInArrow(run, "c long, d long, total long, n long")
    added = parts.groupBy("c", "d").agg(F.sum(F.col("total").cast("decimal(28,0)")).alias("total"), F.sum("n").alias("n")).collect()
    total, n = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
    for r in added:
        total[r["c"], r["d"]], n[r["c"]] = int(r["total"]), r["n"]
    return total, n


def moved(centroids: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The floor of each mean; a centroid without vectors stays."""
    out = centroids.copy()
    for c in np.flatnonzero(n):
        out[c] = [int(t) // int(n[c]) for t in total[c]]
    return out


def assigned(rows: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch in batches:
            chosen, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for at, values in matrices(batch.column("_vector")):
                for i in range(0, len(values), STEP):
                    chosen[at[i : i + STEP]], distance[at[i : i + STEP]] = lists.nearest(scaled(values[i : i + STEP], scale))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(chosen), pa.array(distance)], ["_key", "cluster", "distance"])

    schema = f"_key {rows.schema['_key'].dataType.simpleString()}, cluster int, distance long"
    return rows.mapInArrow(run, schema)


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector that takes part."""
    rows = kept(df, key, vector, scale, dims)
    centroids = first_centroids(rows, k, scale)
    none = rows.sparkSession.createDataFrame([], f"`{key}` {rows.schema['_key'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if not len(centroids):
        return none
    for _ in range(rounds):
        centroids = moved(centroids, *sums(rows, centroids, scale))
    found = stored(assigned(rows, centroids, scale), "clusters")
    own = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(own.values())
    fits = lambda n: n if n < 1 << 63 else None
    # One row for each of the k centroids: small enough to broadcast.
    known = rows.sparkSession.createDataFrame(
        [(c, fits(own[c]), fits(whole), ",".join(map(str, centroids[c].tolist()))) for c in own], "cluster int, cluster_inertia long, inertia long, _components string"
    )
    return found.join(F.broadcast(known), "cluster").select(
        F.col("_key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.col("_components").cast("binary"), 256).alias("centroid_sha256")
    )
