"""Hard negatives from zone-mapped blocks of vectors in Hilbert order.

Vectors are whole numbers: component x is floor(scale * x), so every score (the
inner product) is exact. Rows are ordered by number of components, label and
place on a Hilbert curve through the dimensions of largest variance, and cut
into blocks, written as Parquet with the least and largest value of each
dimension (its zone map) and of the label.

Anchors travel in groups of neighbours on the curve. Interval arithmetic on a
zone map bounds the scores that an anchor can have in a block. A block is read
for an anchor's positives if it may hold the label and its bound reaches the
fifth best score of the anchor's own block; for negatives, if it may hold
another label and its bounds meet one of the anchor's windows (from four fifths
of a positive's score up to that score). Blocks that no anchor of a group needs
are not read for the group.

Rows with a null id, label or vector, or a null or non-finite component, take
no part, and neither do vectors so large that scores may leave 64 bits (number
of components times the largest square from 2**62 on). An anchor is scored with
vectors of as many components; "other" rows are those of another id. Repeated
rows each count, also as anchors. Of equal scores smaller ids come first. No
rows give no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrow import stored
from gridloom.llm.vectors import BLOCK, FEW, GROUP, best, binary, few, matrices, merged, met, row, rows, tiles, to_arrow_schema, usable

#: Rows of a part of the index, and the most parts.
ROWS, PARTS = 8192, 20_000
#: Dimensions of the curve, and bits of each.
AXES, BITS = 8, 4
LOWEST = np.iinfo(np.int64).min
INDEX = "kind string, size int, part int, no int, ids binary, labels binary, data binary, low binary, high binary, seeds binary"
PAIR = "g_part int, g_no int, b_part int, b_no int"


def curve(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates of ``bits`` bits (Skilling's transform)."""
    x = [c.astype(np.int64).copy() for c in cells.T]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(len(cells), np.int64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    place = np.zeros(len(cells), np.int64)
    for bit in reversed(range(bits)):
        for c in x:
            place = place << 1 | ((c ^ turn) >> bit & 1)
    return place


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole matrices; as doubles where those are exact."""
    reach = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if reach < 1 << 53:
        return a.astype(float) @ b.astype(float).T
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product that each anchor can have with a vector inside each box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def taking_part(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    largest = F.coalesce(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double") * scale))), F.lit(0.0)) + 1
    small = F.when(usable(vector), F.size(vector) * largest * largest < float(1 << 62)).otherwise(False)
    return df.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & small).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))


def shape(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, and mean and deviation of each component: sums that Spark adds up, one row for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = np.zeros(1), np.zeros(1), np.zeros(1)
        for batch in batches:
            n[0] += batch.num_rows
            for _, values in matrices(batch.column("vector")):
                more = max(0, values.shape[1] + 1 - len(n))
                n, total, square = (np.pad(a, (0, more)) for a in (n, total, square))
                at = slice(1, values.shape[1] + 1)
                n[at] += len(values)
                total[at] += values.sum(axis=0)
                square[at] += (values * values).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(total), pa.array(square)], ["d", "n", "t", "q"])

    got = df.select("vector").mapInArrow(run, "d long, n double, t double, q double").groupBy("d").agg(F.sum("n"), F.sum("t"), F.sum("q")).orderBy("d").collect()
    n, total, square = (np.array([r[i] for r in got]) for i in (1, 2, 3)) if got else (np.zeros(1),) * 3
    mean = total[1:] / np.maximum(n[1:], 1)
    return int(n[0]), mean, np.sqrt(np.maximum(square[1:] / np.maximum(n[1:], 1) - mean * mean, 0))


def placed(df: DataFrame, scale: int, mean: np.ndarray, deviation: np.ndarray) -> DataFrame:
    """``id, label, size, curve, turn, data``: whole vectors with their place on the curve. ``turn`` spreads rows of equal id."""
    axes = np.argsort(-deviation, kind="stable")[:AXES]
    schema = to_arrow_schema("id long, label long, size int, curve long, turn int, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for at, values in matrices(batch.column("vector")):
                n, size = values.shape
                own = [d for d in axes if d < size]
                cells = np.zeros((n, AXES), np.int64)
                if own:
                    step = np.maximum(deviation[own] * 4 / (1 << BITS), 1e-300)
                    cells[:, : len(own)] = np.clip(np.floor((values[:, own] - mean[own]) / step) + (1 << BITS >> 1), 0, (1 << BITS) - 1)
                whole = np.floor(values * scale).astype("<i4")
                offsets = pa.py_buffer((np.arange(n + 1) * size * 4).astype(np.int32))
                data = pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(binary(whole))])
                take = pa.array(at)
                turns = (turn + np.arange(n)) % 1024
                turn += n
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("label").take(take), pa.array(np.full(n, size, np.int32)), pa.array(curve(cells)), pa.array(turns.astype(np.int32)), data], schema=schema)

    return df.mapInArrow(run, "id long, label long, size int, curve long, turn int, data binary")


def packed(batches: Iterator[pa.RecordBatch], every: int, k: int) -> Iterator[pa.RecordBatch]:
    """A sorted part of the index as rows of packed blocks, zone maps and groups of anchors."""
    schema, part = to_arrow_schema(INDEX), TaskContext.get().partitionId()
    number = {"block": 0, "zones": 0, "anchors": 0}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    zones: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
    anchors: list[tuple[np.ndarray, ...]] = []

    def out(kind: str, size: int, **values: np.ndarray) -> pa.RecordBatch:
        number[kind] += 1
        return row({"kind": kind, "size": size, "part": part, "no": number[kind] - 1} | {n: binary(v) for n, v in values.items()}, schema)

    def block(size: int) -> pa.RecordBatch:
        ids, labels, data = (np.concatenate(x) for x in zip(*held))
        held.clear()
        mine = np.flatnonzero(ids % every == 0)
        seeds = np.full(len(mine), LOWEST)
        for tile in tiles(len(mine), len(ids)):
            scores = np.where((labels[mine[tile]][:, None] == labels) & (ids[mine[tile]][:, None] != ids), product(data[mine[tile]], data), -np.inf)
            if scores.shape[1] >= k:
                fifth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                seeds[tile] = np.where(np.isfinite(fifth), np.nextafter(np.where(np.isfinite(fifth), fifth, 0), -np.inf), LOWEST).astype(np.int64)
        if len(mine):
            anchors.append((ids[mine], labels[mine], data[mine], seeds))
        zones.append((number["block"], labels.min(), labels.max(), data.min(axis=0, initial=2**31 - 1), data.max(axis=0, initial=-(2**31))))
        return out("block", size, ids=ids, labels=labels, data=data)

    def flush(size: int, all_of: bool) -> Iterator[pa.RecordBatch]:
        while held and (all_of or sum(len(h[0]) for h in held) >= BLOCK):
            yield block(size)
        if zones and (all_of or len(zones) >= BLOCK):
            no, first, last, low, high = (np.array(x) for x in zip(*zones))
            zones.clear()
            yield out("zones", size, ids=no.astype(np.int64), labels=np.stack([first, last]), low=low, high=high)
        if anchors and (all_of or sum(len(a[0]) for a in anchors) >= GROUP):
            ids, labels, data, seeds = (np.concatenate(x) for x in zip(*anchors))
            anchors.clear()
            for i in range(0, len(ids), GROUP):
                s = slice(i, i + GROUP)
                yield out("anchors", size, ids=ids[s], labels=labels[s], data=data[s], seeds=seeds[s])

    size = None
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        cuts = np.flatnonzero(np.diff(sizes)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(sizes)]):
            if begin == end:
                continue
            if size is not None and sizes[begin] != size:
                yield from flush(size, True)
            size = int(sizes[begin])
            ids, labels = batch.column("id").to_numpy()[begin:end], batch.column("label").to_numpy()[begin:end]
            data = np.frombuffer(b"".join(batch.column("data")[i].as_buffer() for i in range(begin, end)), "<i4").reshape(end - begin, size)
            at = 0
            while at < end - begin:
                room = BLOCK - sum(len(h[0]) for h in held)
                held.append((ids[at : at + room], labels[at : at + room], data[at : at + room]))
                at += room
                yield from flush(size, False)
    if size is not None:
        yield from flush(size, True)


def index(df: DataFrame, scale: int, every: int, k: int) -> tuple[DataFrame, int]:
    """The written index, and its number of parts."""
    n, mean, deviation = shape(df)
    parts = min(max(-(-n // ROWS), 1), PARTS)
    order = ["size", "label", "curve", "id", "turn"]
    ranged = placed(df, scale, mean, deviation).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = ranged.mapInArrow(lambda batches: packed(batches, every, k), INDEX)
    written = stored(made, "hard-negatives")
    last = written.agg(F.max("part")).first()[0]
    return written, 0 if last is None else last + 1


def numbers(values: dict, name: str, dtype: str = "<i8") -> np.ndarray:
    return np.frombuffer(values[name], dtype)


def vectors_of(values: dict, name: str, n: int) -> np.ndarray:
    return np.frombuffer(values[name], "<i4").reshape(n, values["size"])


def windows(values: dict, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of each anchor's windows, one for each positive; of missing positives an empty one."""
    low, high = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), LOWEST)
    keys, scores, _ = positives(values)
    first = np.searchsorted(keys, keys, "left")
    nth = np.arange(len(keys)) - first
    low[keys, nth], high[keys, nth] = scores - scores // 5, scores
    return low, high


def positives(values: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return numbers(values, "keys"), -numbers(values, "scores"), numbers(values, "ids")


def choice(negative: bool, k: int):
    """Blocks that some anchor of a group must read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in rows(batches):
            labels, blocks = numbers(v, "g_labels"), numbers(v, "z_no")
            first, last = numbers(v, "z_labels").reshape(2, -1)
            least, most = bounds(vectors_of(v, "g_data", len(labels)), vectors_of(v, "low", len(blocks)), vectors_of(v, "high", len(blocks)))
            own = labels[:, None]
            if negative:
                low, high = windows(v, len(labels), k)
                need = np.zeros(least.shape, bool)
                for j in range(k):
                    need |= (most >= low[:, j : j + 1]) & (least <= high[:, j : j + 1]) & (low[:, j : j + 1] <= high[:, j : j + 1])
                need &= ~((first == own) & (last == own))
            else:
                need = (first <= own) & (own <= last) & (most >= numbers(v, "g_seeds")[:, None])
            found = blocks[need.any(axis=0)].astype(np.int32)
            same = lambda x: pa.array(np.full(len(found), x, np.int32))
            yield pa.RecordBatch.from_arrays([same(v["g_part"]), same(v["g_no"]), same(v["b_part"]), pa.array(found)], ["g_part", "g_no", "b_part", "b_no"])

    return run


def reading(negative: bool, k: int):
    """The best k of each anchor (or window) in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(FEW)
        for v in rows(batches):
            ids, labels, others, their = numbers(v, "g_ids"), numbers(v, "g_labels"), numbers(v, "b_ids"), numbers(v, "b_labels")
            anchors, block = vectors_of(v, "g_data", len(ids)), vectors_of(v, "b_data", len(others))
            low, high = windows(v, len(ids), k) if negative else (None, None)
            found = []
            for tile in tiles(len(ids), len(others)):
                scores = product(anchors[tile], block)
                same = labels[tile][:, None] == their
                if negative:
                    for j in range(k):
                        at, to = np.nonzero(~same & (scores >= low[tile, j : j + 1]) & (scores <= high[tile, j : j + 1]))
                        found.append(best((at + tile.start) * k + j, -scores[at, to].astype(np.int64), others[to], k))
                else:
                    at, to = np.nonzero(same & (ids[tile][:, None] != others) & (scores >= numbers(v, "g_seeds")[tile][:, None]))
                    found.append(best(at + tile.start, -scores[at, to].astype(np.int64), others[to], k))
            every = best(*(np.concatenate(x) for x in zip(*found)), k)
            if len(every[0]):
                yield row(few(v, every), schema)

    return run


def answers(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in rows(batches):
            ids, (of, score, positive) = numbers(v, "g_ids"), positives(v)
            keys, minus, negative = numbers(v, "n_keys"), numbers(v, "n_scores"), numbers(v, "n_ids")
            begin = np.searchsorted(of, keys // k, "left") + keys % k
            rank = np.arange(len(keys)) - np.searchsorted(keys, keys, "left") + 1
            made = [ids[keys // k], positive[begin], rank.astype(np.int32), negative, score[begin], -minus]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return run


def mine(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, every: int = 100, k: int = 5) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors, rows whose id ``every`` divides.

    A positive is one of the ``k`` best other rows of the anchor's label; for
    each, the ``k`` best rows of other labels whose score lies in its window.
    """
    made, parts = index(taking_part(df, key, vector, label, scale), scale, every, k)
    of = lambda kind, **names: made.filter(F.col("kind") == kind).select("size", *[F.col(a).alias(b) for a, b in names.items()])
    blocks = of("block", part="b_part", no="b_no", ids="b_ids", labels="b_labels", data="b_data").drop("size")
    zones = of("zones", part="b_part", ids="z_no", labels="z_labels", low="low", high="high")
    anchors = of("anchors", part="g_part", no="g_no", ids="g_ids", labels="g_labels", data="g_data", seeds="g_seeds")

    def searched(groups: DataFrame, negative: bool) -> DataFrame:
        pairs = met(groups, zones, parts).mapInArrow(choice(negative, k), PAIR)
        return merged(pairs.join(groups, ["g_part", "g_no"]).join(blocks, ["b_part", "b_no"]).mapInArrow(reading(negative, k), FEW), k, np.int64)

    near = stored(anchors.drop("g_seeds").join(searched(anchors, False).drop("b_part"), ["g_part", "g_no"]), "positives")
    far = searched(near, True).select("g_part", "g_no", *[F.col(c).alias(f"n_{c}") for c in ("keys", "scores", "ids")])
    return near.join(far, ["g_part", "g_no"]).mapInArrow(answers(k), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
