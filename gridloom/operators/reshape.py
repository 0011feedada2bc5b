"""Read-back: star facts and raw rows to corrected tables.

A corrected row is ``file_id, sheet, line_no, entity MAP<name, text>, label,
value``; the map becomes real columns only at the sink, where the columns of
the sheet are known.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.dates import date_label, is_date_header
from gridloom.functions.text import cell_text, is_blank, number_text
from gridloom.operators.blocks import running_sum
from gridloom.operators.grid import SHEET, TABLE, parse_sub_table, with_columns

LINE = [*SHEET, "line_no"]
#: Columns that are sent to every task at most; more of them meet the facts as Spark sees fit.
SENT = 1 << 18
#: Facts to a task that puts lines together, and lines to one that writes them.
LINED, WRITTEN = 1 << 17, 1 << 18


def value_of_fact() -> Column:
    """The number if there is one, else the text."""
    return F.coalesce(number_text(F.col("value_num")), F.col("value_text"))


def few(columns: DataFrame) -> bool:
    return columns.count() <= SENT


def named_values(fact: DataFrame, columns: DataFrame, dates: str = "name", sent: bool | None = None) -> DataFrame:
    """Facts with their column's name and text value.

    ``dates='name'`` tests the header again; ``'verified'`` believes the load: its
    verdict in ``columns`` (``dim_column(..., keep_verdict=True)``), which also
    holds for accepted headers of impossible dates. Columns are ``sent`` to the
    facts if they are ``few``: facts compress so well that Spark would send them.
    """
    named = columns.select("column_key", F.col("original_name").alias("name"), *(["is_date"] if dates != "name" else []))
    joined = fact.join(F.broadcast(named) if (few(columns) if sent is None else sent) else named, "column_key")
    is_date = is_date_header(F.col("name"), trimmed=False) if dates == "name" else F.col("is_date")
    return joined.select(*LINE, "load_no", "name", value_of_fact().alias("value"), is_date.alias("is_date"))


def ordered_values(fact: DataFrame, columns: DataFrame) -> DataFrame:
    """Values by file, sheet, line and column name (byte order)."""
    return named_values(fact, columns).select(*LINE, "name", "value").orderBy(*LINE, "name", "value")


def lines(values: DataFrame) -> DataFrame:
    """One row per line: ``entity`` map and ``dated`` array of (name, value).

    Of repeated (line, column) values the latest load wins. One shuffle by line
    serves both aggregations, and no group is wider than a sheet row. It has as
    many tasks as the facts ask for: their bytes tell little of what they take unpacked.
    """
    latest = (
        values.repartition(values.count() // LINED + 1, *LINE)
        .groupBy(*LINE, "name", "is_date")
        .agg(F.max_by("value", F.struct("load_no", "value")).alias("value"))
    )
    cell = F.struct("name", "value")
    kept = F.col("is_date") & ~is_blank(F.col("value"))
    return latest.groupBy(*LINE).agg(
        F.map_from_entries(F.collect_list(F.when(~F.col("is_date"), cell))).alias("entity"),
        F.array_sort(F.collect_list(F.when(kept, cell))).alias("dated"),
    )


def corrected_inverted(values: DataFrame) -> DataFrame:
    """One row per line and non-blank date value; lines without values vanish."""
    cells = lines(values).select(*LINE, "entity", F.explode("dated").alias("_c"))
    return cells.select(*LINE, "entity", date_label(F.col("_c.name")).alias("label"), F.col("_c.value").alias("value"))


def inverted_sheets(values: DataFrame) -> DataFrame:
    return values.filter("is_date").select(*SHEET).distinct()


def corrected_normal(values: DataFrame) -> DataFrame:
    """Lines of the sheets without any date column, as they were."""
    none = F.lit(None).cast("string")
    plain = values.join(inverted_sheets(values), SHEET, "left_anti")
    return lines(plain).select(*LINE, "entity", none.alias("label"), none.alias("value"))


def corrected(values: DataFrame) -> DataFrame:
    """Both kinds at once: lines are built and shuffled one time, and meet their sheet's kind."""
    kinds = values.groupBy(*SHEET).agg(F.bool_or("is_date").alias("_inverted"))
    rows = lines(values).join(kinds, SHEET).filter(~F.col("_inverted") | (F.size("dated") > 0))
    cells = rows.select(*LINE, "entity", F.explode_outer("dated").alias("_c"))
    return cells.select(*LINE, "entity", F.when(F.col("_c").isNotNull(), date_label(F.col("_c.name"))).alias("label"), F.col("_c.value").alias("value"))


def raw_tables(raw: DataFrame, tables: DataFrame) -> DataFrame:
    """Raw rows in the shape of corrected ones: the original table."""
    rows = with_columns(raw, tables)
    width = F.size("cells")
    last = F.filter(
        F.arrays_zip("cells", "columns"),
        lambda z: z["cells"].isNotNull()
        & z["columns"].isNotNull()
        & (z["columns"]["next_same"].isNull() | (z["columns"]["next_same"] > width)),
    )
    entity = F.map_from_entries(F.transform(last, lambda z: F.struct(z["columns"]["name"], cell_text(z["cells"]))))
    none = F.lit(None).cast("string")
    return rows.select(
        "file_id", F.col("table_name").alias("sheet"), "line_no", entity.alias("entity"), none.alias("label"), none.alias("value")
    )


def raw_only(raw_keys: DataFrame, fact_keys: DataFrame) -> DataFrame:
    """(file, sheet) pairs that exist only in the raw layer."""
    return raw_keys.select(*SHEET).distinct().join(fact_keys.select(*SHEET).distinct(), SHEET, "left_anti")


def export_set(corrected_rows: DataFrame, raw_rows: DataFrame, only_raw: DataFrame) -> DataFrame:
    """Corrected sheets and the raw-only ones, with their ``origin``."""
    rest = raw_rows.join(only_raw, SHEET, "left_semi")
    return corrected_rows.withColumn("origin", F.lit("fact")).unionByName(
        rest.withColumn("origin", F.lit("raw")), allowMissingColumns=True
    )


def sheet_columns(values: DataFrame) -> DataFrame:
    """Entity columns of each sheet in first-seen order: ``file_id, sheet, columns``, and whether it is inverted."""
    first = values.groupBy(*SHEET, "name", "is_date").agg(F.min("line_no").alias("first_line"))
    return first.groupBy(*SHEET).agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(~F.col("is_date"), F.struct("first_line", "name")))), lambda c: c["name"]
        ).alias("columns"),
        F.bool_or("is_date").alias("inverted"),
    )


def project(rows: DataFrame, columns: Sequence[str], inverted: bool, date: str = "Data", value: str = "Valor") -> DataFrame:
    """Corrected rows of sheets with the same columns, as real columns; missing entities are ''."""
    names = unique_names([*columns, date, value] if inverted else columns)
    named = [F.coalesce(F.col("entity")[c], F.lit("")).alias(n) for c, n in zip(columns, names)]
    if inverted:
        named += [F.col("label").alias(names[-2]), F.col("value").alias(names[-1])]
    return rows.select(*LINE, *named)


def unique_names(names: Sequence[str]) -> list[str]:
    """Names made unique with _2, _3, …: a table format needs distinct ones."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name.lower()] = n = seen.get(name.lower(), 0) + 1
        out.append(name if n == 1 else f"{name}_{n}")
    return out


# ---- stacked tables ------------------------------------------------------


def base_sheet(name: Column) -> Column:
    return F.substring_index(name, "__T", 1)


def aligned(values: DataFrame) -> DataFrame:
    """Corrected rows of sub-tables with their row ``position``: ``file_id, sheet, table_no, position, …``.

    Positions count corrected rows, so they are a running sum over lines of each
    sub-table, taken in blocks of lines. A line of a sub-table without date
    columns is one row, without label and value.
    """
    kinds = values.groupBy(*SHEET).agg(F.bool_or("is_date").alias("_inverted"))
    rows = lines(values).join(kinds, SHEET).withColumn("_n", F.when(F.col("_inverted"), F.size("dated")).otherwise(1)).filter("_n > 0")
    placed = running_sum(rows, SHEET, "line_no", F.col("_n"), "_upto")
    cells = placed.select(*LINE, "entity", (F.col("_upto") - F.col("_n") + 1).alias("_first"), F.posexplode_outer("dated").alias("_i", "_c"))
    return cells.select(
        "file_id", base_sheet(F.col("sheet")).alias("sheet"), parse_sub_table(F.col("sheet"))[1].alias("table_no"),
        (F.col("_first") + F.coalesce("_i", F.lit(0))).alias("position"), "entity",
        date_label(F.col("_c.name")).alias("label"), F.col("_c.value").alias("value"),
    )


def side_by_side(rows: DataFrame, columns: Mapping[int, Sequence[str]], date: str = "Data", value: str = "Valor") -> DataFrame:
    """Sub-tables next to each other by row position, shorter ones padded with ''.

    ``columns`` names the entity columns of each sub-table, so no job looks for
    pivot values; every output cell is a plain aggregate. A sub-table that it
    doesn't name is an error.
    """
    known = F.col("table_no").isin(list(columns))
    rows = rows.withColumn("table_no", F.when(known, F.col("table_no")).otherwise(F.raise_error(F.concat(F.lit("no columns given for sub-table "), F.coalesce(F.col("table_no").cast("string"), F.lit("null")))).cast("int")))

    def of(table: int, expr: Column, name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("table_no") == table, expr)), F.lit("")).alias(f"t{table}_{name}")

    cells = []
    for table, names in columns.items():
        cells += [of(table, F.coalesce(F.col("entity")[c], F.lit("")), c) for c in names]
        cells += [of(table, F.col("label"), date), of(table, F.col("value"), value)]
    return rows.groupBy(*SHEET, "position").agg(*cells)


# ---- everything that there is to export ----------------------------------


def export_layout(values: DataFrame, tables: DataFrame, date: str = "Data", value: str = "Valor") -> DataFrame:
    """Sheets to write and the tables they are made of: ``file_id, sheet`` (the table), ``base, origin, columns, inverted, part, widths, header``.

    Tables with facts are corrected ones; of those in ``tables`` (the catalog)
    without facts the original goes out. Sub-tables share their base sheet: side
    by side if there are several, under the plain name if there is one.
    """
    known = sheet_columns(values).select(*SHEET, F.lit("fact").alias("origin"), "columns", "inverted")
    raw = tables.filter("n_rows >= 1").select("file_id", F.col("table_name").alias("sheet"), F.lit("raw").alias("origin"), F.array_distinct("header").alias("columns"), F.lit(False).alias("inverted"))
    both = known.unionByName(raw.join(known.select(*SHEET), SHEET, "left_anti"))
    name, number = parse_sub_table(F.col("sheet"))
    names = F.concat("columns", F.when(F.col("inverted"), F.array(F.lit(date), F.lit(value))).otherwise(F.array().cast("array<string>")))
    of_base = both.select("file_id", name.alias("base"), F.coalesce(number, F.lit(0)).alias("table_no"), "sheet", "origin", "columns", "inverted", names.alias("names"))
    # A sheet's tables in one row: as many as the sheet has stacked, each with its column names only.
    grouped = of_base.groupBy("file_id", "base").agg(F.array_sort(F.collect_list(F.struct("table_no", "sheet", "origin", "columns", "inverted", "names"))).alias("t"))
    several = F.size("t") > 1
    prefixed = F.flatten(F.transform("t", lambda t: F.transform(t["names"], lambda n: F.concat(F.lit("t"), t["table_no"].cast("string"), F.lit("_"), n))))
    wide = grouped.select("file_id", "base", F.when(several, F.transform("t", lambda t: F.size(t["names"]))).alias("widths"), F.when(several, prefixed).otherwise(F.col("t")[0]["names"]).alias("header"), F.posexplode("t").alias("part", "t"))
    return wide.select("file_id", "t.sheet", "base", "t.origin", "t.columns", "t.inverted", "part", "widths", "header")


def export_tasks(values: DataFrame, raw: DataFrame) -> int:
    """Tasks to write everything in: no more lines go out than there are facts and raw rows."""
    return (values.count() + raw.count()) // WRITTEN + 1


def export_lines(values: DataFrame, raw: DataFrame, tables: DataFrame, layout: DataFrame) -> DataFrame:
    """Every line to write, as text cells under its sheet's header: ``file_id, sheet`` (the base one), ``origin, line_no, nth, header, cells``.

    Lines of a sheet stand in the order of (line_no, nth). The facts are shuffled
    once, by line; only stacked sheets are shuffled again, by position.
    """
    none = F.array().cast("array<struct<name:string,value:string>>")
    originals = raw_tables(raw, tables).select(*LINE, "entity", none.alias("dated"), F.lit("raw").alias("origin"))
    every = lines(values).withColumn("origin", F.lit("fact")).unionByName(originals).join(layout, [*SHEET, "origin"])
    every = every.withColumn("_n", F.when(F.col("inverted"), F.size("dated")).otherwise(1)).filter("_n > 0")
    fixed = F.transform("columns", lambda c: F.coalesce(F.col("entity")[c], F.lit("")))
    cells = F.when(F.col("inverted"), F.concat(fixed, F.array(date_label(F.col("_c.name")), F.col("_c.value")))).otherwise(fixed)
    alone = every.filter("widths is null").select("*", F.posexplode_outer("dated").alias("_i", "_c"))
    plain = alone.select("file_id", F.col("base").alias("sheet"), "origin", "line_no", F.coalesce("_i", F.lit(0)).alias("nth"), "header", cells.alias("cells"))
    stacked = running_sum(every.filter("widths is not null"), SHEET, "line_no", F.col("_n"), "_upto").select("*", F.posexplode_outer("dated").alias("_i", "_c"))
    placed = stacked.select("file_id", "base", "origin", (F.col("_upto") - F.col("_n") + 1 + F.coalesce("_i", F.lit(0))).alias("line_no"), "header", "widths", "part", cells.alias("cells"))
    # The header is the same in all lines of a sheet; of a position each table has one line at most.
    met = placed.groupBy("file_id", "base", "line_no", "header", "widths").agg(F.min("origin").alias("origin"), F.map_from_entries(F.collect_list(F.struct("part", "cells"))).alias("_of"))
    side = F.flatten(F.transform("widths", lambda w, i: F.coalesce(F.col("_of")[i], F.array_repeat(F.lit(""), w))))
    return plain.unionByName(met.select("file_id", F.col("base").alias("sheet"), "origin", "line_no", F.lit(0).alias("nth"), "header", side.alias("cells")))
