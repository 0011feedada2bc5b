"""Helpers for operators that work on Arrow batches: bounded blocks of rows, columns added to a DataFrame, shared folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import shared_folder

#: Bytes of text that a task works on at a time. A single longer text is a block of its own.
BLOCK = 2 << 20


def text_of(column: pa.Array) -> pa.Array:
    """As UTF-8 strings with 64-bit offsets; null is empty."""
    return column.cast(pa.large_string()).fill_null("")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a column made by ``text_of``."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str | None, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows, in slices whose texts have at most ``size`` bytes together."""
    for batch in batches:
        if column is None or batch.num_rows < 2:
            yield batch
            continue
        _, at = buffers(text_of(batch.column(column)))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of df that have none of the names, in either case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def annotated(df: DataFrame, text: str, added: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], keep: list[str] | None = None) -> DataFrame:
    """df with more columns, made from blocks of rows without a shuffle.

    ``make()`` runs once in each task and gives the function of a block. A
    column of df that has the name of an added one gives way to it.
    """
    fields = T._parse_datatype_string(added) if isinstance(added, str) else added
    keep = without(df.select(*keep) if keep is not None else df, fields.names)
    schema = T.StructType([df.schema[c] for c in keep] + fields.fields)
    read = [*keep, *([text] if text not in keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for block in blocks(batches, text):
            made = of(block)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), *made], [*keep, *fields.names])

    return df.select(*read).mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written below the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, divisor: int):
    """crc32 of an id as text, modulo; of a null id too."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor
