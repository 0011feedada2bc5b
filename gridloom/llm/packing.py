"""Packing of documents into sequences by cutting-stock column generation.

Documents are tokenised and cut into full sequences and a rest. Rests are
counted in length classes of ``step`` ids. A linear program over the histogram
chooses patterns (how many rests of each class share a sequence): columns are
generated by a knapsack dynamic program over the prices of the current basis.
The rounded-down solution, and first-fit patterns for the few rests left by
rounding, are then dealt to documents by their rank in their class.

The histogram has as many entries as classes, whatever the number of documents,
so the program runs on the driver. Ranks are prefix sums over partitions: no
task sees a whole class. Ids move once, to their sequence.

Nulls: a null text is empty: its one id is the end id. A row with a null id is
packed like any other. Repeated rows are packed each. No rows: no pieces.
Columns other than id and text play no role.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.arrow import blocks, stored, text_of
from gridloom.llm.tokens import encoder

#: Up to so many (task, class) counts, of some 40 bytes each, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, class int, part int, place long"


def binaries(values: np.ndarray, length: np.ndarray) -> pa.Array:
    """Stretches of values, one after the other, as bytes."""
    ends = np.append(0, np.cumsum(length)) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(values)]).cast(pa.binary())


def pieces(df: DataFrame, tokenizer: str, cut: str | None, end_id: int, size: int, step: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: full sequences of a document, and its rest. ``class``: length in steps, rounded up; ``place``: its number in its class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, seen = TaskContext.get().partitionId(), encoder(tokenizer, cut), np.zeros(-(-size // step) + 1, np.int64)
        for block in blocks(batches, "text"):
            own, at = encode.flat(text_of(block.column("text")))
            made = np.insert(own, at[1:], end_id)  # the end id after each text
            total = np.diff(at) + 1
            count = -(-total // size)
            row = np.repeat(np.arange(len(total)), count)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
            length = np.minimum(size, total[row] - start)
            cls = -(-length // step)
            place = pd.Series(cls).groupby(cls).cumcount().to_numpy() + seen[cls]
            seen += np.bincount(cls, minlength=len(seen))
            ids = binaries(made, length)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(total[row]), ids, pa.array(cls.astype(np.int32)), pa.array(np.full(len(row), part, np.int32)), pa.array(place)],
                [c.split()[0] for c in PIECES.split(", ")],
            )

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def knapsack(prices: np.ndarray) -> tuple[float, np.ndarray]:
    """The dearest pattern that fits: prices[c] for a piece of c + 1 steps, capacity len(prices) steps."""
    n = len(prices)
    best, last = np.zeros(n + 1), np.full(n + 1, -1)  # -1: a step stays empty
    for room in range(1, n + 1):
        value = best[room - 1 :: -1][:room] + prices[:room]
        c = int(np.argmax(value))
        best[room] = max(best[room - 1], value[c])
        last[room] = c if value[c] > best[room - 1] + 1e-12 else -1
    pattern, room = np.zeros(n, np.int64), n
    while room > 0:
        if last[room] >= 0:
            pattern[last[room]] += 1
        room -= int(last[room]) + 1 if last[room] >= 0 else 1
    return float(best[n]), pattern


def solve(demand: np.ndarray, gap: float = 1e-4, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that every class is served exactly.

    demand[c]: pieces of c + 1 steps. Stops once the bound of the prices is
    within ``gap`` of the value, or after ``rounds`` columns; either way the
    patterns serve all pieces.
    """
    n = len(demand)
    basis = np.diag(n // np.arange(1, n + 1)).astype(float)  # column j: only pieces of class j
    inverse = np.diag(1 / np.diag(basis))
    used, cost = inverse @ demand, np.ones(n)
    for _ in range(rounds):
        prices = cost @ inverse
        low = int(np.argmin(prices))
        if prices[low] < -1e-9:  # serving more of this class than there is costs nothing
            pattern, price = -np.eye(n)[low], 0.0
        else:
            value, pattern = knapsack(prices)
            price = 1.0
            if value <= 1 + gap:
                break
        way = inverse @ pattern
        ratios = np.where(way > 1e-9, used / np.where(way > 1e-9, way, 1), np.inf)
        leaves = int(np.argmin(ratios))
        basis[:, leaves], cost[leaves] = pattern, price
        used -= way * ratios[leaves]
        used[leaves] = ratios[leaves]
        row = inverse[leaves] / way[leaves]
        inverse -= np.outer(way, row)
        inverse[leaves] = row
    left, out = demand.astype(np.int64).copy(), []
    for j in np.argsort(-used, kind="stable"):
        pattern = basis[:, j].round().astype(np.int64)
        held = pattern > 0 if cost[j] else np.zeros(n, bool)
        times = int(min(np.floor(max(used[j], 0) + 1e-9), (left[held] // pattern[held]).min())) if held.any() else 0
        if times:
            out.append((pattern, times))
            left -= pattern * times
    while left.any():  # at most one sequence a class was cut off by rounding
        pattern, room = np.zeros(n, np.int64), n
        for c in np.flatnonzero(left)[::-1]:
            pattern[c] = min(left[c], room // (c + 1))
            room -= int(pattern[c]) * (c + 1)
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        out.append((pattern, times))
        left -= pattern * times
    return out


def pack(df: DataFrame, tokenizer: str, cut: str | None = "space", end_id: int = 1, size: int = 2048, step: int = 8) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian), sequence_id, offset, padded_to.

    ``padded_to``: the sequence's length with padding; a sequence that fills a
    power of two stays as it is.
    """
    spark = df.sparkSession
    table = stored(pieces(df, tokenizer, cut, end_id, size, step), "pieces")
    classes = -(-size // step)
    counts = table.groupBy("part", "class").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("class").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = stored(counts.select("part", "class", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    if bases.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    demand = np.zeros(classes, np.int64)
    for cls, n in table.groupBy("class").agg(F.count("*").alias("n")).collect():  # a row per class
        demand[cls - 1] = n
    steps, sequences = [[(0, 0, 1)] for _ in range(classes)], 0  # of a class: ranks from, sequence from, pieces in each
    served = np.zeros(classes, np.int64)
    for pattern, times in solve(demand):
        for c in np.flatnonzero(pattern):
            steps[c].append((int(served[c]), sequences, int(pattern[c])))
        served += pattern * times
        sequences += times
    steps = [s[1:] or s for s in steps]
    arrays = [np.array(s, np.int64) for s in steps]

    @F.pandas_udf("long")
    def sequence(cls: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(cls), np.int64)
        for c, at in cls.groupby(cls).indices.items():
            own, r = arrays[c - 1], rank.to_numpy()[at]
            k = np.searchsorted(own[:, 0], r, "right") - 1
            out[at] = own[k, 1] + (r - own[k, 0]) // own[k, 2]
        return pd.Series(out)

    placed = table.join(bases, ["part", "class"]).withColumn("rank", F.col("base") + F.col("place")).withColumn("sequence_id", sequence("class", "rank"))
    inside = W.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")  # a sequence has at most ``size`` pieces
    total = F.sum("length").over(W.partitionBy("sequence_id"))
    placed = placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).withColumn("total", total)
    power = F.col("total").bitwiseAND(F.col("total") - 1) == 0
    padded = F.when(power, F.col("total")).otherwise(F.lit(size).cast("long"))
    return placed.select("doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset", padded.alias("padded_to"))


def digest(packed: DataFrame, dtype: str) -> DataFrame:
    """The rows of ``pack`` with ids' crc32 as unsigned 32-bit integers in their place."""

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(x, dtype).astype("<u4")) for x in ids], dtype="int64")

    return packed.withColumn("ids_crc32", crc("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to")
