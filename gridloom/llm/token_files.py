"""Token-ID files: flat unsigned integers, 64-bit document offsets, memory-mapped on reading.

A file set holds documents in ascending order of id. Part p has

* ``p.bin``: the ids of its documents, end id included, little-endian;
* ``p.off``: one unsigned 64-bit count more than documents, ids before each document in this part;
* ``p.doc``: the signed 64-bit document ids, null ids (which come first) as 0.

Ids before a part (its base) are prefix sums over the parts. Documents are
dealt by ranges of (id, hash of the text), so equal ids don't meet in one part.
A part is written under another name and renamed, so a task that runs again
leaves the same files.

Nulls: a null text is empty, and has the end id only; null document ids come
first. Equal ids are ordered by text. No rows: no documents, empty parts.
Columns other than id and text play no role.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.arrow import blocks, partitions, text_of
from gridloom.llm.tokens import encoder
from gridloom.session import shared_folder

PARTS = "part int, n_docs long, n_ids long, n_null long, base long"


def folder_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and path that tasks can open; the folder is shared by all of them."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_token_files(df: DataFrame, folder: str, tokenizer: str, cut: str | None, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write df's texts as token files below folder; one row for each part, with its base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, path = folder_of(folder)
        files.create_dir(path, recursive=True)
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer, cut)
        end, name = np.array([end_id], encode.dtype).tobytes(), f"{path}/{part:06d}"
        draft = f"{name}.{uuid.uuid4().hex}"
        total = docs = nulls = 0
        with files.open_output_stream(f"{draft}.bin") as ids, files.open_output_stream(f"{draft}.off") as off, files.open_output_stream(f"{draft}.doc") as doc:
            off.write(np.zeros(1, "<u8").tobytes())
            for block in blocks(batches, "text"):
                pieces = [x + end for x in encode.ids(text_of(block.column("text")).to_pylist())]
                sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // encode.dtype.itemsize
                ids.write(b"".join(pieces))
                off.write((total + np.cumsum(sizes)).astype("<u8").tobytes())
                doc.write(block.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                total, docs, nulls = total + int(sizes.sum()), docs + len(pieces), nulls + block.column("doc_id").null_count
        for kind in ("bin", "off", "doc"):
            files.move(f"{draft}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [docs], "n_ids": [total], "n_null": [nulls]})

    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions(spark), F.asc_nulls_first("doc_id"), "h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "text")
    # One row for each part, as many as partitions: the driver may hold them.
    parts = sorted(map(tuple, dealt.select("doc_id", "text").mapInArrow(run, PARTS.removesuffix(", base long")).collect()))
    bases = np.concatenate([[0], np.cumsum([p[2] for p in parts], dtype=np.int64)]).tolist()
    return spark.createDataFrame([(*p, b) for p, b in zip(parts, bases)], PARTS)


def read_token_files(parts: DataFrame, folder: str, dtype: str, added: str, per_part: Callable[[np.ndarray, np.ndarray], list]) -> DataFrame:
    """One row per document: doc_id, start (ids before it), n_tokens, and what per_part makes of mapped ids and the part's offsets."""
    names = [c.split()[0] for c in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = folder_of(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if not row["n_docs"]:
                    continue
                name = f"{path}/{row['part']:06d}"
                if isinstance(files, pafs.LocalFileSystem):
                    ids, off, doc = (np.memmap(f"{name}.{k}", t, "r") for k, t in (("bin", dtype), ("off", "<u8"), ("doc", "<i8")))
                else:
                    ids, off, doc = (np.frombuffer(files.open_input_file(f"{name}.{k}").readall(), t) for k, t in (("bin", dtype), ("off", "<u8"), ("doc", "<i8")))
                for i in range(0, row["n_docs"], 5000):
                    at = off[i : i + 5001].astype(np.int64)
                    own = pa.array(doc[i : i + 5000].astype(np.int64), mask=np.arange(i, i + len(at) - 1) < row["n_null"])
                    made = per_part(ids[at[0] : at[-1]], at - at[0])
                    yield pa.RecordBatch.from_arrays([own, pa.array(at[:-1] + row["base"]), pa.array(np.diff(at)), *made], ["doc_id", "start", "n_tokens", *names])

    return parts.repartition(partitions(parts.sparkSession), "part").mapInArrow(run, f"doc_id long, start long, n_tokens long, {added}")


def crc32s(ids: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """crc32 of each document's ids as little-endian unsigned 32-bit integers."""
    wide = np.ascontiguousarray(ids.astype("<u4"))
    return [pa.array([zlib.crc32(wide[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())]


def token_files(spark: SparkSession, documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write documents' token files to a fresh shared folder, read them back, one row per document."""
    folder = shared_folder(spark, "token-files")
    parts = write_token_files(documents, folder, tokenizer, "blank", end_id)
    dtype = encoder(tokenizer, "blank").dtype.str
    return read_token_files(parts, folder, dtype, "ids_crc32 long", crc32s)
