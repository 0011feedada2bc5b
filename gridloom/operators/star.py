"""Star schema: dimensions, facts and the joined views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridloom.functions.dates import date_key, header_date
from gridloom.functions.text import normalized_name
from gridloom.operators.unpivot import column_key

FACT = [
    "load_no", "file_id", "date_key", "column_key", "schema_hash", "sheet", "line_no",
    "value_text", "value_num", "value_date",
]
# The name of a file that is not registered.
UNKNOWN_FILE = "desconhecido"


def fact(unpivoted: DataFrame) -> DataFrame:
    return unpivoted.select(*FACT)


def dim_date(headers: DataFrame, name: str = "name") -> DataFrame:
    """One row per distinct date of the given date headers; impossible headers give none."""
    # Parse each distinct header once: an aggregate keeps the null test from moving below the first one.
    names = headers.select(name).distinct().groupBy(name).agg(F.first(header_date(F.col(name))).alias("full_date"))
    dates = names.filter("full_date is not null").select("full_date").distinct()
    d = F.col("full_date")
    return dates.select(
        date_key(d).alias("date_key"), d, F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"),
        F.quarter(d).alias("quarter"), F.date_format(d, "MMMM").alias("month_name"), F.weekday(d).alias("weekday"),
    )


def dim_column(fact: DataFrame, verdict: DataFrame, keep_verdict: bool = False) -> DataFrame:
    """Columns with at least one value. The first value decides the type of a fixed column; dates are numbers.

    ``keep_verdict`` adds the load's ``is_date``. Facts are read by a hash aggregate
    over narrow columns: a line number and its value's kind make one long, least by
    (column, file, sheet); only those few are compared across files.
    """
    packed = F.min(2 * F.col("line_no") + F.col("value_text").isNotNull().cast("int")).alias("_p")
    by_sheet = fact.groupBy("column_key", "file_id", "sheet").agg(packed)
    order = F.struct(F.floor(F.col("_p") / 2), "file_id", "sheet")
    used = by_sheet.groupBy("column_key").agg(F.min_by(F.col("_p") % 2 == 1, order).alias("_is_text"))
    names = verdict.select("schema_hash", "name", "is_date").distinct()
    known = names.withColumn("column_key", column_key(F.col("schema_hash"), F.col("name")))
    return known.join(used, "column_key").select(
        "column_key", "schema_hash", F.col("name").alias("original_name"), normalized_name(F.col("name")).alias("normalized_name"),
        F.when(F.col("_is_text") & ~F.col("is_date"), "text").otherwise("number").alias("dtype"),
        *(["is_date"] if keep_verdict else []),
    )


def dim_column_inverted(layout: DataFrame, entity: str) -> DataFrame:
    """The one column of inverted mode, for every schema with a date header."""
    hashes = layout.filter(F.exists("columns", lambda c: c["is_date"])).select("schema_hash")
    return hashes.select(
        column_key(F.col("schema_hash"), F.lit(entity)).alias("column_key"), "schema_hash", F.lit(entity).alias("original_name"),
        normalized_name(F.lit(entity)).alias("normalized_name"), F.lit("text").alias("dtype"),
    )


def dim_file(raw: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files with raw rows; ``manifest`` gives their names."""
    files = raw.select("file_id").distinct().join(manifest.select("file_id", "name"), "file_id", "left")
    return files.select(
        F.col("file_id").alias("file_key"), F.coalesce("name", F.lit(UNKNOWN_FILE)).alias("name"),
        F.concat(F.lit("db://"), F.col("file_id").cast("string")).alias("source_uri"),
    )


def add_new(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: rows of ``existing`` stay, unknown keys of ``new`` are added once."""
    fresh = new.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")
    return existing.unionByName(fresh)


def star_view(fact: DataFrame, files: DataFrame, dates: DataFrame, columns: DataFrame) -> DataFrame:
    """Fact left-joined to its three dimensions. Spark picks broadcasts by size."""
    return (
        fact.join(files.select(F.col("file_key").alias("file_id"), F.col("name").alias("file_name"), "source_uri"), "file_id", "left")
        .join(dates.select("date_key", "full_date", "year", "month", "day", "quarter", "month_name", "weekday"), "date_key", "left")
        .join(columns.select("column_key", "original_name", "normalized_name", "dtype"), "column_key", "left")
    )


def uri_file_id(uri):
    """File id of a ``db://n`` address, null when it is not a number."""
    return F.replace(uri, F.lit("db://"), F.lit("")).try_cast("bigint")


def name_of(ids: DataFrame, names: DataFrame, key: str, name: str, default: str) -> DataFrame:
    """Look names up by id, with a default for unknown ids."""
    return ids.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))
