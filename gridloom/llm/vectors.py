"""Helpers for operators on vectors: rows of numbers as matrices, packed blocks of rows, the best few of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrow import partitions

#: Vectors in a packed block, and queries in a packed group.
BLOCK = 1024
GROUP = 512
#: Scores that a task holds at a time.
CELLS = 1 << 18


def usable(vector: str) -> Column:
    """The vector is there, with neither null nor non-finite components (NaN is above infinity here)."""
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the vectors of equal size, and those vectors as a matrix of doubles, for each size that occurs."""
    column = column.cast(pa.large_list(pa.float64()))
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[at[rows][:, None] + np.arange(size)]


def tiles(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows whose scores against the columns are few enough to hold."""
    step = max(1, CELLS // max(columns, 1))
    return (slice(i, i + step) for i in range(0, rows, step))


def best(keys: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k smallest (score, id) of each key, sorted by key, score, id."""
    order = np.lexsort((ids, score, keys))
    keys, score, ids = keys[order], score[order], ids[order]
    first = np.searchsorted(keys, keys, "left")
    kept = np.arange(len(keys)) - first < k
    return keys[kept], score[kept], ids[kept]


ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def to_arrow_schema(columns: str) -> pa.Schema:
    """Of ``name type, name type, …``; workers have no session to ask."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in columns.split(","))])


def binary(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def met(groups: DataFrame, others: DataFrame, parts: int) -> DataFrame:
    """Each packed group of queries next to the packed rows of every part (``b_part``) with vectors of its size: the query set in blocks against all rows."""
    spread = groups.withColumn("b_part", F.explode(F.sequence(F.lit(0), F.lit(max(parts - 1, 0)))))
    return spread.join(others, ["size", "b_part"])


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: packed rows are large, so no more than one is turned into Python."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def row(values: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([values], schema)


#: The best few of a group's queries, from the blocks of a part: key is the number of the query (or of its window) in the group.
FEW = "g_part int, g_no int, b_part int, keys binary, scores binary, ids binary"


def few(values: dict, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict:
    return {n: values[n] for n in ("g_part", "g_no", "b_part")} | {"keys": binary(found[0].astype(np.int64)), "scores": binary(found[1]), "ids": binary(found[2].astype(np.int64))}


def opened(values: dict, dtype: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(values["keys"], np.int64), np.frombuffer(values["scores"], dtype), np.frombuffer(values["ids"], np.int64)


def merged(df: DataFrame, k: int, dtype: type) -> DataFrame:
    """The best k of each key of each group; first among the blocks of a part, then among parts, each as a stream."""
    spark = df.sparkSession

    def level(names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, held = None, None
            for values in rows(batches):
                if last is not None and any(values[n] != last[n] for n in names):
                    yield row(few(last, held), to_arrow_schema(FEW))
                    last = None
                own = opened(values, dtype)
                held = best(*own, k) if last is None else best(*(np.concatenate(two) for two in zip(held, own)), k)
                last = values
            if last is not None:
                yield row(few(last, held), to_arrow_schema(FEW))

        return run

    for names in (["g_part", "g_no", "b_part"], ["g_part", "g_no"]):
        df = df.repartition(partitions(spark), *names).sortWithinPartitions(*names).mapInArrow(level(names), FEW)
    return df
