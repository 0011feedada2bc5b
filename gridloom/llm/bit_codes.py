"""Nearest neighbours by randomly rotated one-bit codes.

A vector, less the mean of all, is turned at random into ``code_bits``
dimensions and keeps one bit of each: its sign. Two scalars go with the code,
the length of the vector and the inner product (``fit``) of its direction with
the code's. From them the inner product of a vector and a query is estimated as
<code, query> / fit, with an error that has deviation
sqrt((1 - fit^2) / (fit^2 (bits - 1))); ``margin`` deviations are the bound.

Codes are read in two passes, vectors only where they are chosen. The first
pass gives each query ``FIRST`` vectors by their estimate; their exact distances
give a radius that holds ``k`` vectors. The second pass chooses every vector
whose lower bound of distance lies within the radius, and these are ranked by
exact distance. A true neighbour is missed only where its error passes the bound.

Queries are the rows whose id ``every`` divides; their own candidates are all
rows of other ids. Rows with a null id take no part, nor do vectors that are
null, zero, or hold null or non-finite components. A query meets vectors of as
many components. Repeated rows each count, also as queries. Of equal distances
smaller ids come first. No rows give no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrow import stored
from gridloom.llm.hard_negatives import shape
from gridloom.llm.vectors import FEW, GROUP, best, binary, few, matrices, merged, met, row, rows, tiles, to_arrow_schema, usable

#: Vectors of a block.
BLOCK = 4096
#: Vectors that each query ranks exactly to find its radius.
FIRST = 32
#: Deviations of the estimate's error that the bound allows.
MARGIN = 4.0
INDEX = "kind string, size int, part int, no int, ids binary, codes binary, lengths binary, fits binary, data binary"
CHOSEN = "g_part int, g_no int, b_part int, b_no int, queries binary, places binary"
BITS_OF_PLACE, BITS_OF_BLOCK = 12, 20


def code_bits(size: int) -> int:
    """At least 256, so that short vectors too have sharp bounds; whole bytes."""
    return max(256, -(-size // 8) * 8)


class Turn:
    """A random rotation of vectors of one size, the same in every task."""

    def __init__(self, size: int, mean: np.ndarray, seed: int = 1):
        self.mean = mean[:size]
        self.bits = code_bits(size)
        self.axes = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.bits, size)))[0].T

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the vectors less the mean, and their turned directions; a vector equal to the mean has none."""
        rest = vectors - self.mean
        length = np.sqrt((rest * rest).sum(axis=1))
        return length, (rest / np.where(length > 0, length, 1)[:, None]) @ self.axes


def coded(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits, and the inner product of each direction with its code's."""
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def estimates(turned: np.ndarray, codes: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """Estimated inner product of each turned query with each coded direction."""
    bits = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    return (turned.astype(np.float32) @ signs.T) / (np.sqrt(bits) * np.where(fits > 0, fits, 1))


def errors(fits: np.ndarray, bits: int, margin: float) -> np.ndarray:
    return np.where(fits > 0, margin * np.sqrt(np.maximum(1 - fits * fits, 0) / np.where(fits > 0, fits * fits, 1) / (bits - 1)) + 1e-5, 0)


def shortest(values: np.ndarray) -> np.ndarray:
    """As single precision where that loses nothing."""
    single = values.astype("<f4")
    return single if (single == values).all() else values.astype("<f8")


def vectors_of(data: bytes, size: int, n: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if len(data) == 4 * n * size else "<f8").reshape(n, size).astype(float)


def packed(batches: Iterator[pa.RecordBatch], mean: np.ndarray, every: int) -> Iterator[pa.RecordBatch]:
    """A task's rows as packed codes, vectors and groups of queries; sizes apart."""
    schema, part = to_arrow_schema(INDEX), TaskContext.get().partitionId()
    turns: dict[int, Turn] = {}
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    asked: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    number = {"block": 0, "group": 0}

    def joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*parts))

    def out(kind: str, size: int, no: int, **values: np.ndarray) -> pa.RecordBatch:
        return row({"kind": kind, "size": size, "part": part, "no": no} | {n: binary(v) for n, v in values.items()}, schema)

    def block(size: int) -> Iterator[pa.RecordBatch]:
        ids, vectors = joined(held.pop(size))
        if size not in turns:
            if len(turns) >= 8:
                turns.clear()
            turns[size] = Turn(size, mean)
        length, turned = turns[size](vectors)
        codes, fits = coded(turned)
        no, number["block"] = number["block"], number["block"] + 1
        yield out("codes", size, no, ids=ids, codes=codes, lengths=length, fits=np.where(length > 0, fits, 0))
        yield out("vectors", size, no, data=shortest(vectors), ids=ids)

    def group(size: int) -> Iterator[pa.RecordBatch]:
        ids, vectors = joined(asked.pop(size))
        for i in range(0, len(ids), GROUP):
            no, number["group"] = number["group"], number["group"] + 1
            yield out("queries", size, no, ids=ids[i : i + GROUP], data=shortest(vectors[i : i + GROUP]))

    def full(parts: dict, limit: int) -> list[int]:
        """Sizes whose rows fill a block, and all while more than a few sizes are open."""
        return list(parts) if len(parts) > 8 else [s for s, held_of in parts.items() if sum(len(i) for i, _ in held_of) >= limit]

    for batch in batches:
        every_id = batch.column("id").to_numpy()
        for at, values in matrices(batch.column("vector")):
            size = values.shape[1]
            for i in range(0, len(at), BLOCK):
                ids, vectors = every_id[at[i : i + BLOCK]], values[i : i + BLOCK]
                held.setdefault(size, []).append((ids, vectors))
                mine = ids % every == 0
                if mine.any():
                    asked.setdefault(size, []).append((ids[mine], vectors[mine]))
                for s in full(held, BLOCK):
                    yield from block(s)
                for s in full(asked, GROUP):
                    yield from group(s)
    for s in list(held):
        yield from block(s)
    for s in list(asked):
        yield from group(s)


def places(values: dict, at: np.ndarray) -> np.ndarray:
    """Part, block and row in one number."""
    return ((values["b_part"] << BITS_OF_BLOCK) + values["b_no"] << BITS_OF_PLACE) + at


def bounded(values: dict, turns: dict[int, Turn], mean: np.ndarray, margin: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For slices of a group's queries: estimates and lower bounds of the squared distance to each vector of a block; own ids are out of reach."""
    size, n = values["size"], len(values["g_ids"]) // 8
    if size not in turns:
        turns.clear()
        turns[size] = Turn(size, mean)
    turn = turns[size]
    ids, own = np.frombuffer(values["b_ids"], np.int64), np.frombuffer(values["g_ids"], np.int64)
    codes = np.frombuffer(values["codes"], np.uint8).reshape(len(ids), turn.bits // 8)
    lengths, fits = np.frombuffer(values["lengths"]), np.frombuffer(values["fits"])
    error = errors(fits, turn.bits, margin)
    length, turned = turn(vectors_of(values["g_data"], size, n))
    for tile in tiles(n, len(ids)):
        inner = estimates(turned[tile], codes, fits)
        own_length = length[tile][:, None]
        squares = own_length**2 + lengths**2
        apart = np.where(ids == own[tile][:, None], np.inf, 0)
        reach = np.where(fits > 0, np.minimum(inner + error, 1), 0)
        yield tile, squares - 2 * own_length * lengths * inner + apart, squares - 2 * own_length * lengths * reach + apart


def first_estimates(mean: np.ndarray, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, Turn] = {}
        for v in rows(batches):
            found = []
            for tile, about, _ in bounded(v, turns, mean, 0):
                m = min(first, about.shape[1])
                to = np.argpartition(about, m - 1, axis=1)[:, :m]
                score = np.take_along_axis(about, to, axis=1)
                at, nth = np.nonzero(score < np.inf)
                found.append((at + tile.start, score[at, nth], places(v, to[at, nth])))
            yield row(few(v, best(*(np.concatenate(x) for x in zip(*found)), first)), to_arrow_schema(FEW))

    return run


def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group's chosen vectors by the block they lie in."""
    schema = to_arrow_schema(CHOSEN)
    for v in rows(batches):
        keys, place = np.frombuffer(v["keys"], np.int64), np.frombuffer(v["ids"], np.int64)
        block = place >> BITS_OF_PLACE
        for b in np.unique(block):
            own = np.flatnonzero(block == b)
            at = place[own] & (1 << BITS_OF_PLACE) - 1
            yield row({"g_part": v["g_part"], "g_no": v["g_no"], "b_part": int(b) >> BITS_OF_BLOCK, "b_no": int(b) & (1 << BITS_OF_BLOCK) - 1, "queries": binary(keys[own].astype(np.int32)), "places": binary(at.astype(np.int32))}, schema)


def within_radius(mean: np.ndarray, margin: float):
    """Every vector of a block whose lower bound lies within the radius of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, turns = to_arrow_schema(CHOSEN), {}
        for v in rows(batches):
            radius = np.frombuffer(v["radius"])
            found = []
            for tile, _, least in bounded(v, turns, mean, margin):
                limit = radius[tile][:, None]
                # What isn't a number can't be ruled out; an own row is infinitely far.
                at, to = np.nonzero(~(least > limit * limit * (1 + 1e-5)) & ~np.isposinf(least))
                found.append((at + tile.start, to))
            queries, at = (np.concatenate(x) for x in zip(*found))
            if len(queries):
                yield row({n: v[n] for n in ("g_part", "g_no", "b_part", "b_no")} | {"queries": binary(queries.astype(np.int32)), "places": binary(at.astype(np.int32))}, schema)

    return run


def exact(k: int):
    """Distances of the chosen vectors, in double precision; the best k of each query and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(FEW)
        for v in rows(batches):
            size, ids = v["size"], np.frombuffer(v["b_ids"], np.int64)
            asking, vectors = vectors_of(v["g_data"], size, len(v["g_ids"]) // 8), vectors_of(v["b_data"], size, len(ids))
            queries, at = np.frombuffer(v["queries"], np.int32), np.frombuffer(v["places"], np.int32)
            found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
            for tile in tiles(len(queries), size):
                apart = asking[queries[tile]] - vectors[at[tile]]
                found.append((queries[tile].astype(np.int64), np.sqrt(np.cumsum(apart * apart, axis=1)[:, -1]), ids[at[tile]]))
            yield row(few(v, best(*(np.concatenate(x) for x in zip(*found)), k)), schema)

    return run


def radii(k: int):
    """Each query's distance to its k-th vector so far; without end where there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in rows(batches):
            n = len(v["g_ids"]) // 8
            radius = np.full(n, np.inf)
            if v["keys"] is not None:
                keys, distance = np.frombuffer(v["keys"], np.int64), np.frombuffer(v["scores"])
                last = np.flatnonzero(np.arange(len(keys)) - np.searchsorted(keys, keys, "left") == k - 1)
                radius[keys[last]] = distance[last]
            yield row({"size": v["size"], "g_part": v["g_part"], "g_no": v["g_no"], "g_ids": v["g_ids"], "g_data": v["g_data"], "radius": binary(radius)}, to_arrow_schema(RADII))

    return run


RADII = "size int, g_part int, g_no int, g_ids binary, g_data binary, radius binary"


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for v in rows(batches):
        ids, keys = np.frombuffer(v["g_ids"], np.int64), np.frombuffer(v["keys"], np.int64)
        rank = np.arange(len(keys)) - np.searchsorted(keys, keys, "left") + 1
        made = [ids[keys], rank.astype(np.int32), np.frombuffer(v["ids"], np.int64), np.frombuffer(v["scores"])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["query_id", "rank", "vec_id", "score"])


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, margin: float = MARGIN, first: int = FIRST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest vectors found for each query, and their Euclidean distance."""
    nonzero = F.when(usable(vector), F.exists(vector, lambda x: x != 0)).otherwise(False)
    own = df.filter(F.col(key).isNotNull() & nonzero).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    _, mean, _ = shape(own)
    made = stored(own.mapInArrow(lambda batches: packed(batches, mean, every), INDEX), "bit-codes")
    last = made.agg(F.max("part")).first()[0]
    parts = 0 if last is None else last + 1
    of = lambda kind, **names: made.filter(F.col("kind") == kind).select("size", *[F.col(a).alias(b) for a, b in names.items()])
    codes = of("codes", part="b_part", no="b_no", ids="b_ids", codes="codes", lengths="lengths", fits="fits")
    vectors = of("vectors", part="b_part", no="b_no", ids="b_ids", data="b_data").drop("size")
    groups = of("queries", part="g_part", no="g_no", ids="g_ids", data="g_data")

    def ranked(chosen: DataFrame) -> DataFrame:
        near = chosen.join(groups, ["g_part", "g_no"]).join(vectors, ["b_part", "b_no"])
        return merged(near.mapInArrow(exact(k), FEW), k, np.float64).drop("b_part")

    some = merged(met(groups, codes, parts).mapInArrow(first_estimates(mean, first), FEW), first, np.float64)
    reached = groups.join(ranked(some.mapInArrow(dealt, CHOSEN)), ["g_part", "g_no"], "left").mapInArrow(radii(k), RADII)
    chosen = met(stored(reached, "radii"), codes, parts).mapInArrow(within_radius(mean, margin), CHOSEN)
    return groups.join(ranked(chosen), ["g_part", "g_no"]).mapInArrow(answers, "query_id long, rank int, vec_id long, score double")
