"""Counts, listings and scans over the stored layers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from gridloom.operators.grid import SHEET


def layer_counts(layers: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each layer: ``layer, n``."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n") for name, df in layers.items()]
    together = counts[0]
    for other in counts[1:]:
        together = together.unionByName(other)
    return together


def schema_count(tables: DataFrame) -> DataFrame:
    return tables.agg(F.count_distinct("schema_hash").alias("n_schemas"))


def rows_per_schema(raw: DataFrame) -> DataFrame:
    return raw.groupBy("schema_hash").agg(F.count("*").alias("n"))


def rows_per_sheet(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SHEET).agg(F.count("*").alias("n"))


def files_with_facts(fact: DataFrame, files: DataFrame) -> DataFrame:
    listed = fact.select(F.col("file_id").alias("file_key")).distinct().join(files, "file_key")
    return listed.select("file_key", "name").orderBy("name", "file_key")


def sheets_of_files(fact: DataFrame) -> DataFrame:
    return fact.select(*SHEET).distinct().orderBy(*SHEET)


def columns_of_sheets(fact: DataFrame, columns: DataFrame) -> DataFrame:
    used = fact.select(*SHEET, "column_key").distinct()
    return used.join(columns.select("column_key", "original_name"), "column_key").select(*SHEET, "original_name").orderBy(
        *SHEET, "original_name"
    )


def raw_of_schema(raw: DataFrame, schema_hash: str) -> DataFrame:
    """Rows of one schema by line: exact for a whole hash, else by prefix."""
    match = F.col("schema_hash") == schema_hash if len(schema_hash) == 32 else F.col("schema_hash").startswith(schema_hash)
    return raw.filter(match).orderBy("line_no", "file_id", "table_name")


def raw_of_table(raw: DataFrame, file_id: int, table_name: str, limit: int | None = None) -> DataFrame:
    """Rows of one table by line; a preview gives its own limit."""
    rows = raw.filter((F.col("file_id") == file_id) & (F.col("table_name") == table_name)).orderBy("line_no")
    return rows if limit is None else rows.limit(limit)
