"""Stored layers of loads: what a file holds now replaces all that it held, however little that is.

A layer keeps the rows of each load in a folder of their own, which is never
rewritten, and a ledger of which (file, sheet) came with which load:

    rows/load=3/bucket=a7/…     rows of load 3; bucket: first two digits of the schema's hash
    ledger/v000003/…            file_id, sheet, load, n_rows, is_current, as of load 3

A load is one write of its rows and one small write of the next ledger, which
takes effect by the rename of its folder. A job that dies before the rename
leaves the layer as it was; what it wrote is not in any ledger, and the next
load writes over it (``_staged-…`` beside them holds rows on their way, and is
dropped once they are written). Reading takes the rows of the loads up to the last ledger,
less those of superseded sheets (an anti join with the few that are). ``compact``
writes the rows that still count once more and drops the rest.

One writer at a time; the file system must rename a folder in one step.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_PLACE = ["load", "bucket"]
#: Values that a task sorts by folder: a few hundred MB of cells, less of plain columns.
VALUES = 1 << 22


class Layer:
    """Rows with ``file_id``, a sheet column and ``schema_hash``, stored below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, sheet: str = "sheet"):
        self.spark, self.path, self.schema, self.sheet = spark, path.rstrip("/"), schema, sheet
        self.key = ["file_id", sheet]
        self.entry = f"file_id bigint, `{sheet}` string, load bigint, n_rows bigint, is_current boolean"

    def _folder(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def version(self) -> int:
        """Number of the last load that took effect; 0 before any."""
        system, target = self._folder("ledger")
        if not system.exists(target):
            return 0
        names = [s.getPath().getName() for s in system.listStatus(target)]
        return max((int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()), default=0)

    def ledger(self, version: int | None = None) -> DataFrame:
        """``file_id, sheet, load, n_rows, is_current``: every sheet that was ever loaded, also without rows."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.entry)
        return self.spark.read.schema(self.entry).parquet(f"{self.path}/ledger/v{version:06d}")

    def read(self, history: bool = False) -> DataFrame:
        """The rows that count now; with ``history`` those of superseded loads too, and their ``load``."""
        version = self.version()
        if not version:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.withColumn("load", F.lit(0).cast("bigint")) if history else empty
        stored = self.spark.read.schema(f"{self.schema}, load bigint, bucket string").parquet(f"{self.path}/rows").filter(F.col("load") <= version)
        if history:
            return stored.drop("bucket")
        gone = self.ledger(version).filter("not is_current").select(*self.key, "load")
        if not gone.isEmpty():
            stored = stored.join(gone, [*self.key, "load"], "left_anti")
        return stored.drop(*_PLACE)

    def load(self, rows: DataFrame, loaded: DataFrame | None = None, replace: bool = True) -> int:
        """Store rows as the next load, and return its number.

        ``loaded`` lists what was read, ``file_id`` and sheet, also sheets without
        rows (a file without any sheet has a null one): all that these files held
        before is superseded. Without it, the sheets found in ``rows`` supersede
        themselves, under whatever schema they were. ``replace`` off only adds.
        """
        version = self.version()
        number = version + 1
        self._write(rows, number)
        counted = self.spark.read.schema(f"{self.schema}, load bigint, bucket string").parquet(f"{self.path}/rows").filter(F.col("load") == number)
        counted = counted.groupBy(*self.key).agg(F.count("*").alias("n_rows"))
        if loaded is not None:
            counted = loaded.select(F.col("file_id").cast("bigint").alias("file_id"), self.sheet).distinct().join(counted, self.key, "full_outer")
        new = counted.select(*self.key, F.lit(number).cast("bigint").alias("load"), F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), F.lit(True).alias("is_current"))
        old = self.ledger(version)
        if replace:
            same = ["file_id"] if loaded is not None else self.key
            hit = new.select(*same).distinct().withColumn("_hit", F.lit(True))
            old = old.join(hit, same, "left").withColumn("is_current", F.col("is_current") & F.col("_hit").isNull()).select(*new.columns)
        self._commit(old.unionByName(new), number)
        return number

    def compact(self) -> int:
        """Rows that count now, written once more as the next load; superseded ones and their entries are dropped."""
        version = self.version()
        number = version + 1
        self._write(self.read(), number)
        entries = self.ledger(version).filter("is_current").withColumn("load", F.lit(number).cast("bigint"))
        whole = entries.groupBy(*self.key, "load").agg(F.sum("n_rows").alias("n_rows")).withColumn("is_current", F.lit(True))
        self._commit(whole, number)
        for old in range(1, number):
            for name in (f"rows/load={old}", f"ledger/v{old:06d}"):
                system, target = self._folder(name)
                system.delete(target, True)
        return number

    def _write(self, rows: DataFrame, number: int) -> None:
        """Rows by bucket, in tasks of bounded size; no rows leave an empty folder.

        A writer sorts its rows by folder, unpacked, which takes many times their
        bytes in a shuffle (wide sheets: twenty times), so splitting by those doesn't
        bound a task. Rows are put down as they come, their values counted, then
        dealt by ranges to as many tasks as the values ask for.
        """
        target = f"{self.path}/rows/load={number}"
        system, folder = self._folder(f"rows/load={number}")
        system.delete(folder, True)  # of a load that never took effect
        system.mkdirs(folder)
        name = f"_staged-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        staged = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")
        values = reduce(Column.__add__, [F.coalesce(F.size(f.name), F.lit(1)) if isinstance(f.dataType, T.ArrayType) else F.lit(1) for f in rows.schema])
        total = staged.agg(F.sum(values.cast("bigint"))).first()[0] or 0
        bucketed = staged.withColumn("bucket", F.coalesce(F.substring("schema_hash", 1, 2), F.lit("none")))
        dealt = bucketed.repartitionByRange(total // VALUES + 1, "bucket", *self.key, "line_no")
        dealt.write.mode("append").partitionBy("bucket").parquet(target)
        system.delete(self._folder(name)[1], True)

    def _commit(self, ledger: DataFrame, number: int) -> None:
        name = f"ledger/_next-{uuid.uuid4().hex}"
        ledger.write.parquet(f"{self.path}/{name}")
        system, made = self._folder(name)
        _, final = self._folder(f"ledger/v{number:06d}")
        if system.exists(final) or not system.rename(made, final):
            raise RuntimeError(f"load {number} of {self.path} has been written by somebody else")
