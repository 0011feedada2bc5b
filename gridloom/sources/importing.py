"""A folder of sheets to a star, in one call; a file that can't be read is a status, not the end of the job.

Below ``store``: ``manifest`` (a version for each run), ``scan`` (cells of each
run), ``raw`` and ``fact`` (layers of loads), ``tables`` and ``verdict`` by run.
Only files that are new or changed are read; what they held before is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators import catalog, detect, grid, reshape, star
from gridloom.operators.unpivot import unpivot_rows
from gridloom.sources import files, sinks
from gridloom.sources.layer import Layer
from gridloom.sources.workbook import SCHEMA, read_workbooks

MANIFEST = "file_id bigint, name string, path string, mtime timestamp, size bigint, status string"
#: Listed, but not read here; Parquet files have a reader of their own (``files.read_parquet_rows``).
UNREAD = (".parquet",)


def manifest_of(spark: SparkSession, store: str) -> DataFrame:
    """The manifest after the last run; empty before any."""
    runs = Layer(spark, f"{store}/raw", sinks.RAW, "table_name").version()
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifest/run={runs}") if runs else spark.createDataFrame([], MANIFEST)


def scanned(spark: SparkSession, folder: str, todo: DataFrame, sep: str) -> DataFrame:
    """Cells of the files in ``todo``, with an ``error`` where there are none: ``file_id, sheet, row_no, cells, error``."""
    known = todo.select("path", "file_id")
    columns = ["file_id", "sheet", "row_no", "cells", "error"]
    books = read_workbooks(spark, folder, known).select(*columns)
    texts = files.scan_csv(spark, folder, sep).join(known, "path").select(*columns)
    unread = todo.filter(F.lower("name").rlike("(" + "|".join(UNREAD).replace(".", r"\.") + r")\z")).select("file_id", F.lit("no reader for this type of file").alias("error"))
    return books.unionByName(texts).unionByName(unread, allowMissingColumns=True)


def import_folder(spark: SparkSession, folder: str, store: str, detect_tables: bool = True, min_rows: int = 3, threshold: float = 0.7, sep: str = ";") -> DataFrame:
    """List, scan, segment, store and unpivot what is pending; returns the new manifest."""
    run = Layer(spark, f"{store}/raw", sinks.RAW, "table_name").version() + 1

    def kept(df: DataFrame, name: str, schema=None) -> DataFrame:
        path = f"{store}/{name}/run={run}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(schema or df.schema).parquet(path)

    listed = catalog.refresh(manifest_of(spark, store), files.list_files(spark, folder))
    manifest = kept(listed, "listing")
    todo = manifest.filter(F.col("status").isin(catalog.PENDING, catalog.SCANNED))
    scan = kept(scanned(spark, folder, todo, sep), "scan", SCHEMA)
    failed = scan.filter("error is not null").select("file_id").distinct()
    cells = scan.filter("error is null").drop("error").join(failed, "file_id", "left_anti")
    tables = kept(grid.tables(cells, grid.table_extents(cells, detect_tables, min_rows)), "tables")
    read = todo.select("file_id").join(failed, "file_id", "left_anti")
    held = read.join(tables.select("file_id", F.col("table_name").alias("sheet")), "file_id", "left")
    raw = kept(grid.raw_rows(cells, tables), "rows")
    verdict = kept(detect.verdict(raw, detect.schemas(tables), threshold=threshold), "verdict")
    facts = star.fact(unpivot_rows(raw, detect.layout(verdict), tables, run))
    outcome = todo.select("file_id").join(failed.withColumn("_bad", F.lit(True)), "file_id", "left").select("file_id", F.when(F.col("_bad"), catalog.ERROR).otherwise(catalog.INGESTED).alias("status"))
    done = kept(catalog.set_status(manifest, outcome).select(*[c.split()[0] for c in MANIFEST.split(", ")]), "manifest")
    sinks.replace_facts(facts, f"{store}/fact", held)
    sinks.replace_raw(raw, f"{store}/raw", held.withColumnRenamed("sheet", "table_name"))  # last: its version is the run's number
    return done


def values_of(spark: SparkSession, store: str) -> DataFrame:
    """Named values of all files as they are now."""
    fact = sinks.read_facts(spark, f"{store}/fact")
    verdict = spark.read.parquet(f"{store}/verdict").drop("run")
    return reshape.named_values(fact, star.dim_column(fact, verdict), sent=reshape.few(verdict))


def export_folder(spark: SparkSession, store: str, path: str, sep: str = ";") -> None:
    """Everything that the store holds as CSV, one job."""
    raw = sinks.read_raw(spark, f"{store}/raw")
    # A table is as its last run saw it; earlier headers of changed files have no rows left.
    every = spark.read.parquet(f"{store}/tables")
    last = every.join(every.groupBy("file_id").agg(F.max("run").alias("run")), ["file_id", "run"]).drop("run")
    values = values_of(spark, store)
    sinks.write_csv_sheets(reshape.export_lines(values, raw, last, reshape.export_layout(values, last)), path, sep, reshape.export_tasks(values, raw))
