"""Unpivot: date headers become rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from itertools import groupby
import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridloom.functions.dates import DATE_HEADER, date_key, header_date, is_date_header, value_timestamp
from gridloom.functions.text import fingerprint, cell_of, has_value
from gridloom.operators.grid import columns_of, present_cells
from gridloom.operators.skew import join_spread

LINE = ["file_id", "sheet", "line_no"]


def schema_sizes(tables: DataFrame) -> DataFrame:
    return tables.groupBy("schema_hash").agg(F.sum("n_rows").alias("n"))


def column_key(schema_hash: Column, name: Column) -> Column:
    return F.md5(F.concat(schema_hash, F.lit("|"), name).cast("binary"))


def typed_value(cell: Column) -> list[Column]:
    """value_text, value_num, value_date of a non-blank cell: a number, or text and perhaps its timestamp."""
    is_number = cell["kind"].isin("number", "bool")
    text = F.when(~is_number, cell["txt"])
    return [
        text.alias("value_text"),
        F.when(is_number, cell["num"]).alias("value_num"),
        F.when(~is_number, value_timestamp(cell["txt"])).alias("value_date"),
    ]


def unpivot_rows(raw: DataFrame, layout: DataFrame, tables: DataFrame, load_no: int = 0) -> DataFrame:
    """Facts of all schemas, with the column's name and date flag still attached.

    Rows meet the layout of their schema before the explode, so the join moves
    rows, not cells. Every non-blank cell gives one fact; only those of date
    columns carry a date key.
    """
    rows = join_spread(raw, layout, schema_sizes(tables), "schema_hash", ["file_id", "table_name", "line_no"])
    cells = present_cells(rows).filter(has_value(F.col("cells")))
    return cells.select(
        F.lit(load_no).cast("bigint").alias("load_no"), "file_id", F.col("columns.date_key").alias("date_key"),
        column_key(F.col("schema_hash"), F.col("columns.name")).alias("column_key"), "schema_hash",
        F.col("table_name").alias("sheet"), "line_no", *typed_value(F.col("cells")),
        F.col("columns.name").alias("name"), F.col("columns.is_date").alias("is_date"),
    )


def inverted_layout(tables: DataFrame, entity: str, pattern: str = DATE_HEADER) -> DataFrame:
    """Layout for sheets of entities by periods: every fully matching header, no value vote."""
    columns = columns_of(
        tables.filter("n_rows >= 1").groupBy("schema_hash").agg(F.min_by("header", F.struct("file_id", "table_name")).alias("header")),
        ["schema_hash"],
    )
    dated = columns.withColumn("is_date", (F.col("name") != entity) & is_date_header(F.col("name"), pattern, whole=True))
    return dated.withColumn("date_key", F.when(F.col("is_date"), date_key(header_date(F.col("name"))))).groupBy("schema_hash").agg(
        F.array_sort(F.collect_list(F.struct("col_no", "name", "next_same", "is_date", "date_key"))).alias("columns")
    )


def unpivot_inverted(raw: DataFrame, tables: DataFrame, entity: str, pattern: str = DATE_HEADER, load_no: int = 0) -> DataFrame:
    """Inverted mode: date facts only, all pointing to the entity column, which itself is not stored."""
    facts = unpivot_rows(raw, inverted_layout(tables, entity, pattern), tables, load_no)
    return facts.filter("is_date").withColumn("name", F.lit(entity)).withColumn(
        "column_key", column_key(F.col("schema_hash"), F.lit(entity))
    )


# ---- wide DataFrames -----------------------------------------------------


def date_headers(columns: Sequence[str], pattern: str = DATE_HEADER) -> list[str]:
    """Names that look like dates (names are plan metadata, so this needs no job)."""
    return [c for c in columns if re.match(pattern, c.strip())]


def _parsed(name: str) -> date | None:
    parts = [int(p) for p in name.strip().replace("/", "-").split("-")]
    first_is_year = len(name.strip().replace("/", "-").split("-")[0]) == 4
    year, month, day = (parts + [1, 1])[:3] if first_is_year else ([1] + parts)[-3:][::-1]
    try:
        return date(year, month, day)
    except ValueError:
        return None


def quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def unpivot_dates(
    df: DataFrame,
    headers: Sequence[str] | None = None,
    start: date | None = None,
    end: date | None = None,
    pattern: str = DATE_HEADER,
    value: str = "value",
) -> DataFrame:
    """Unpivot the date headers of a wide DataFrame: ids, ``header``, ``date``, ``value``.

    ``start``/``end`` choose headers before the plan is built: a filter on the
    result would only come after every header has been expanded.
    """
    dated = list(headers) if headers is not None else date_headers(df.columns, pattern)
    fixed = [c for c in df.columns if c not in dated]
    if start or end:
        known = {h: _parsed(h) for h in dated}
        dated = [h for h in dated if known[h] and (not start or known[h] >= start) and (not end or known[h] <= end)]
    types = {df.schema[h].dataType for h in dated}
    values = [F.col(f"`{h}`") if len(types) == 1 else F.col(f"`{h}`").cast("string").alias(h) for h in dated]
    narrow = df.select(*quoted(fixed), *values)
    long = narrow.unpivot(quoted(fixed), quoted(dated), "header", value)
    kept = long.filter(F.col(value).isNotNull())
    if isinstance(kept.schema[value].dataType, T.StringType):
        kept = kept.filter(F.col(value) != "")
    # Each header is parsed once; the list has one row per column, so it is safe to broadcast.
    names = df.sparkSession.createDataFrame([(h,) for h in dated], "header string")
    dates = names.select("header", header_date(F.col("header")).alias("date"))
    return kept.join(F.broadcast(dates), "header").select(*quoted(fixed), "header", value, "date")


def _cells(values: Column, dtype: T.DataType) -> Column:
    return F.transform(values, lambda v: cell_of(v, dtype))


def rows_of_wide(df: DataFrame, file_id: Column, table_name: Column, line_no: Column, columns: Sequence[str]) -> DataFrame:
    """Raw rows of a wide DataFrame; its column names are the header. A projection, no shuffle."""
    header = F.array(*[F.lit(c) for c in columns])
    # One lambda per stretch of equally typed columns keeps the generated code short on wide sheets.
    parts = []
    for dtype, names in groupby(columns, key=lambda c: df.schema[c].dataType):
        parts.append(_cells(F.array(*[F.col(f"`{c}`") for c in names]), dtype))
    cells = F.concat(*parts)
    return df.select(
        file_id.cast("bigint").alias("file_id"), table_name.alias("table_name"), line_no.cast("bigint").alias("line_no"),
        fingerprint(header).alias("schema_hash"), cells.alias("cells"),
    )


def tables_of_wide(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Catalog of raw rows that share one header."""
    header = F.array(*[F.lit(c) for c in columns])
    return (
        raw.groupBy("file_id", "table_name", "schema_hash")
        .agg(F.count("*").alias("n_rows"))
        .withColumn("header", header)
        .withColumn("n_cols", F.lit(len(columns)))
    )
