"""Which columns of each schema are dates? One plan for all schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.dates import DATE_HEADER, date_key, header_date, is_date_header, is_date_value
from gridloom.functions.text import cell_text, is_blank, is_float_text, strip
from gridloom.operators.blocks import first_rows
from gridloom.operators.grid import columns_of, present_cells

SAMPLE_ROWS = 500
SAMPLE_VALUES = 5
THRESHOLD = 0.7


def schemas(tables: DataFrame) -> DataFrame:
    """Column universe: the header of each schema's first table with rows."""
    return (
        tables.filter("n_rows >= 1 and schema_hash is not null")
        .groupBy("schema_hash")
        .agg(F.min_by("header", F.struct("file_id", "table_name")).alias("header"))
    )


def sample(raw: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """First rows of each schema in (line, file, table) order, with their ``rank``.

    Lines count from 2 in every table, so the first ``rows`` rows lie within the
    first ``rows`` lines: that filter reaches the scan before anything is sorted.
    """
    near = raw.filter(F.col("line_no") <= rows + 1)
    order = [F.col("line_no"), F.col("file_id"), F.col("table_name")]
    return first_rows(near, ["schema_hash"], order, rows, ["file_id", "table_name"])


def vote(value: Column) -> Column:
    """neutral, hit or miss of a non-blank sample text."""
    v = strip(value)
    return F.when(is_float_text(v), "neutral").when(is_date_value(v), "hit").otherwise("miss")


def accept(hits: Column, misses: Column, neutrals: Column, threshold: float = THRESHOLD) -> Column:
    opinions = hits + misses
    return (
        F.when(hits + misses + neutrals == 0, False)
        .when(opinions == 0, True)
        .when(hits / opinions >= threshold, True)
        .otherwise((neutrals >= 3) & (misses <= 1))
    )


def ballots(values: DataFrame, keys: list[str], n: int = SAMPLE_VALUES) -> DataFrame:
    """Counts of hits, misses and neutrals over the first ``n`` distinct values of each key.

    ``values`` has the keys, the text ``txt`` and the order ``rank``.
    """
    first_seen = values.filter(~is_blank(F.col("txt"))).groupBy(*keys, "txt").agg(F.min("rank").alias("seen"))
    window = Window.partitionBy(*keys).orderBy("seen", "txt")
    opinion = vote(F.col("txt"))
    return (
        first_seen.withColumn("_n", F.row_number().over(window))
        .filter(F.col("_n") <= n)
        .groupBy(*keys)
        .agg(*[F.count_if(opinion == kind).alias(f"{kind}{'es' if kind == 'miss' else 's'}") for kind in ("hit", "miss", "neutral")])
    )


def verdict(
    raw: DataFrame,
    schemas: DataFrame,
    pattern: str = DATE_HEADER,
    sample_rows: int = SAMPLE_ROWS,
    sample_values: int = SAMPLE_VALUES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Every column of every schema: ``schema_hash, col_no, name, next_same, is_date, hits, misses, neutrals``.

    A column is a date when its header matches and its sampled values do not
    object; a candidate without a single value stays fixed.
    """
    columns = columns_of(schemas, ["schema_hash"]).withColumn("candidate", is_date_header(F.col("name"), pattern))
    wanted = (
        columns.groupBy("schema_hash")
        .agg(
            F.array_sort(F.collect_list(F.struct("col_no", "name", "next_same", "candidate"))).alias("columns"),
            F.bool_or("candidate").alias("_any"),
        )
        .filter("_any")
        .drop("_any")
    )
    # At most sample_rows rows per schema come out of the sample.
    sampled = sample(raw, sample_rows).select("schema_hash", "rank", "cells").join(wanted, "schema_hash")
    values = present_cells(sampled).filter("columns.candidate").select(
        "schema_hash", F.col("columns.name").alias("name"), "rank", cell_text(F.col("cells")).alias("txt")
    )
    votes = ballots(values, ["schema_hash", "name"], sample_values)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "misses", "neutrals")]
    return (
        columns.join(votes, ["schema_hash", "name"], "left")
        .select("schema_hash", "col_no", "name", "next_same", "candidate", *counts)
        .withColumn("is_date", F.col("candidate") & accept(F.col("hits"), F.col("misses"), F.col("neutrals"), threshold))
    )


def layout(verdict: DataFrame) -> DataFrame:
    """One row per schema: ``schema_hash, columns`` — an array of column descriptors by position."""
    described = verdict.withColumn("date_key", F.when(F.col("is_date"), date_key(header_date(F.col("name")))))
    return described.groupBy("schema_hash").agg(
        F.array_sort(F.collect_list(F.struct("col_no", "name", "next_same", "is_date", "date_key"))).alias("columns")
    )


def fixed_columns(verdict: DataFrame) -> DataFrame:
    return verdict.filter(~F.col("is_date"))


def without_fixed_columns(verdict: DataFrame) -> DataFrame:
    """Schemas in which every column is a date: the pattern may be too wide."""
    return verdict.groupBy("schema_hash").agg(F.count("*").alias("n_columns"), F.bool_and("is_date").alias("_all")).filter("_all").drop("_all")
