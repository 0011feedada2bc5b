"""Positional grids to tables and raw rows.

A grid is one row per sheet row: ``file_id, sheet, row_no, cells``. ``row_no``
counts 1, 2, … without gaps inside a sheet (an empty row is a row with no or
blank cells); ``cells`` is an array of (kind, num, txt), ragged if need be.

A sheet may be arbitrarily long, so nothing here windows over a whole sheet:
only its blank rows are looked at, in blocks of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.text import cell_text, fingerprint, has_value, header_text, ingested, is_blank, quoted_json
from gridloom.operators.blocks import BLOCK, block_of

SHEET = ["file_id", "sheet"]
TABLE = ["file_id", "table_name"]


def blank_row(cells: Column) -> Column:
    """Every cell null or whitespace; an empty row is blank."""
    return F.coalesce(F.forall(cells, lambda c: (c["kind"] == "blank") | (~c["kind"].isin("number", "bool") & is_blank(c["txt"]))), F.lit(True))


#: Between the texts of a packed row; a row with a text that holds it is not packed.
_BETWEEN = "\0"


def packed(grid: DataFrame) -> DataFrame:
    """Rows for a shuffle: of a row of text cells only the texts, as one string ``_texts``; other rows keep their ``cells``.

    A cell of a word is several times as large as the word, in a shuffle as in a sort.
    """
    alike = F.forall("cells", lambda c: (c["kind"] == "text") & c["num"].isNull() & c["txt"].isNotNull() & ~c["txt"].contains(_BETWEEN))
    marked = grid.withColumn("_alike", F.coalesce((F.size("cells") > 0) & alike, F.lit(False)))
    texts = F.array_join(F.transform("cells", lambda c: c["txt"]), _BETWEEN)
    return marked.withColumn("_texts", F.when(F.col("_alike"), texts)).withColumn("cells", F.when(~F.col("_alike"), F.col("cells"))).drop("_alike")


def unpacked(rows: DataFrame) -> DataFrame:
    """The rows as they were before ``packed``."""
    kind = rows.schema["cells"].dataType
    cells = F.transform(F.split("_texts", _BETWEEN), lambda t: F.struct(F.lit("text").alias("kind"), F.lit(None).cast("double").alias("num"), t.alias("txt")))
    return rows.withColumn("cells", F.when(F.col("_texts").isNotNull(), cells.cast(kind)).otherwise(F.col("cells"))).drop("_texts")


def _segmented(grid: DataFrame, min_rows: int, block: int) -> DataFrame:
    """Per block of rows: its runs of non-blank rows (array ``_runs``, each in the block of the blank row that ends it), and of its
    sheet ``_total`` runs, of which ``_upto`` lie before; ``_start``, ``_end``, and whether the block ``_closes`` the sheet.

    A block's summary (its blank rows' places) is one aggregate. Summaries merge
    along the sheet: the last blank row before a block and the runs before it are
    running values over narrow block rows, joined back to the block. Both sides
    come from one aggregate of the grid, so the grid is read once.
    """
    row, least = F.col("row_no").cast("bigint"), F.lit(max(min_rows, 1))
    blocks = grid.groupBy(*SHEET, block_of("row_no", block).alias("_blk")).agg(
        F.min(row).alias("_low"), F.max(row).alias("_high"), F.sort_array(F.collect_list(F.when(blank_row(F.col("cells")), row))).alias("_blanks")
    )

    def runs(edges: Column) -> Column:
        n = F.size(edges) - 1
        pairs = F.zip_with(F.slice(edges, F.lit(1), n), F.slice(edges, F.lit(2), n), lambda x, y: F.struct((x + 1).alias("start_row"), (y - 1).alias("end_row")))
        return F.filter(pairs, lambda r: r["end_row"] - r["start_row"] + 1 >= least)

    some = F.size("_blanks") > 0
    first, last = F.when(some, F.element_at("_blanks", 1)), F.when(some, F.element_at("_blanks", -1))
    narrow = blocks.select(*SHEET, "_blk", "_low", "_high", first.alias("_first"), last.alias("_last"), F.when(some, F.size(runs(F.col("_blanks")))).otherwise(0).alias("_inside"))
    whole = Window.partitionBy(*SHEET)
    along = whole.orderBy("_blk")
    before = F.max("_last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    told = narrow.select(
        *SHEET, "_blk", "_first", "_last", "_inside", F.min("_low").over(whole).alias("_start"), F.max("_high").over(whole).alias("_end"),
        F.lead("_blk").over(along).isNull().alias("_closes"), before.alias("_before"),
    ).withColumn("_before", F.coalesce("_before", F.col("_start") - 1))
    opens = F.coalesce(F.col("_first") - F.col("_before") - 1 >= least, F.lit(False)).cast("int")
    closes = (F.col("_closes") & (F.col("_end") - F.coalesce("_last", "_before") >= least)).cast("int")
    counted = told.withColumn("_n", (F.col("_inside") + opens + closes).cast("bigint")).select(
        *SHEET, "_blk", "_start", "_end", "_closes", "_before", F.sum("_n").over(whole).alias("_total"),
        (F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_upto"),
    )
    none = F.array().cast("array<bigint>")
    # A block's own ends are used here, so that both sides of the join ask for the same aggregate and share its exchange.
    edges = F.concat(F.array(F.least("_before", F.col("_low") - 1)), "_blanks", F.when(F.col("_closes"), F.array(F.col("_high") + 1)).otherwise(none))
    return blocks.join(counted, [*SHEET, "_blk"]).withColumn("_runs", runs(edges))


def _numbered(runs: Column, before: Column) -> Column:
    return F.transform(runs, lambda r, i: F.struct((before + i + 1).cast("int").alias("table_no"), r["start_row"].alias("start_row"), r["end_row"].alias("end_row")))


def runs_of_rows(grid: DataFrame, min_rows: int = 3, block: int = BLOCK) -> DataFrame:
    """Maximal runs of non-blank rows with at least ``min_rows`` rows, numbered per sheet: ``file_id, sheet, table_no, start_row, end_row``."""
    return _segmented(grid, min_rows, block).select(*SHEET, F.inline(_numbered(F.col("_runs"), F.col("_upto"))))


def table_extents(grid: DataFrame, detect: bool = True, min_rows: int = 3, block: int = BLOCK) -> DataFrame:
    """Row ranges of the tables: ``file_id, sheet, table_no, table_name, start_row, end_row``.

    With ``detect`` off, or with fewer than two runs, the whole sheet (blank rows
    included) is one table, ``table_no`` null, named like the sheet.
    """
    if not detect:
        ends = grid.groupBy(*SHEET).agg(F.min("row_no").cast("bigint").alias("start_row"), F.max("row_no").cast("bigint").alias("end_row"))
        return ends.select(*SHEET, F.lit(None).cast("int").alias("table_no"), F.col("sheet").alias("table_name"), "start_row", "end_row")
    kind = "array<struct<table_no:int,start_row:bigint,end_row:bigint>>"
    unsplit = F.array(F.struct(F.lit(None).cast("int").alias("table_no"), F.col("_start").alias("start_row"), F.col("_end").alias("end_row")))
    tables = F.when(F.col("_total") > 1, _numbered(F.col("_runs"), F.col("_upto")).cast(kind)).when(F.col("_closes"), unsplit.cast(kind))
    found = _segmented(grid, min_rows, block).select(*SHEET, F.inline(tables))
    name = F.when(F.col("table_no").isNull(), F.col("sheet")).otherwise(sub_table_name(F.col("sheet"), F.col("table_no")))
    return found.select(*SHEET, "table_no", name.alias("table_name"), "start_row", "end_row")


def sub_table_name(sheet: Column, table_no: Column) -> Column:
    return F.concat(sheet, F.format_string("__T%03d", table_no))


def parse_sub_table(name: Column) -> tuple[Column, Column]:
    """(sheet, index) of a display name; the index is null for a plain sheet."""
    match = r"(?s)\A(.+)__T(\d+)\z"
    index = F.regexp_extract(name, match, 2).try_cast("int")
    return F.when(index.isNotNull(), F.regexp_extract(name, match, 1)).otherwise(name), index


def tables(grid: DataFrame, extents: DataFrame) -> DataFrame:
    """Extents with header, schema hash and shape (one row per table).

    The grid is never sent whole, however small its files are: both sides are dealt by key.
    """
    first = packed(grid.select(*SHEET, F.col("row_no").cast("bigint").alias("start_row"), "cells"))
    header = F.transform("cells", header_text)
    return (
        unpacked(extents.join(first.hint("merge"), [*SHEET, "start_row"]))
        .withColumn("header", header)
        .select(
            *SHEET, "table_no", "table_name", "start_row", "end_row", "header",
            fingerprint(F.col("header")).alias("schema_hash"),
            (F.col("end_row") - F.col("start_row")).alias("n_rows"),
            F.size("header").alias("n_cols"),
        )
    )


def raw_rows(grid: DataFrame, tables: DataFrame, block: int = BLOCK) -> DataFrame:
    """Data rows: ``file_id, table_name, line_no, schema_hash, cells``.

    Lines count from 2 in each table; cells past the header are dropped, dates
    become text. Tables with no row below the header give none. Each row takes
    the last table start at or before it: one shuffle of the grid, by block.
    """
    spans = tables.select(
        *SHEET, "table_name", "start_row", "end_row", "schema_hash", "n_cols",
        F.explode(F.sequence(block_of("start_row", block), block_of("end_row", block))).alias("_blk"),
    )
    marks = spans.select(
        *SHEET, "_blk", F.greatest("start_row", F.col("_blk") * block).alias("row_no"), F.lit(0).alias("_row"),
        F.struct("table_name", "start_row", "end_row", "schema_hash", "n_cols").alias("_table"),
    )
    rows = packed(grid).select(
        *SHEET, block_of("row_no", block).alias("_blk"), F.col("row_no").cast("bigint").alias("row_no"),
        F.lit(1).alias("_row"), "cells", "_texts",
    )
    window = Window.partitionBy(*SHEET, "_blk").orderBy("row_no", "_row").rowsBetween(Window.unboundedPreceding, 0)
    tagged = rows.unionByName(marks, allowMissingColumns=True).withColumn(
        "_table", F.last("_table", ignorenulls=True).over(window)
    )
    return (
        unpacked(tagged.filter("_row = 1 and row_no > _table.start_row and row_no <= _table.end_row"))
        .select(
            "file_id",
            F.col("_table.table_name").alias("table_name"),
            (F.col("row_no") - F.col("_table.start_row") + 1).alias("line_no"),
            F.col("_table.schema_hash").alias("schema_hash"),
            F.transform(F.slice("cells", F.lit(1), F.col("_table.n_cols")), ingested).alias("cells"),
        )
    )


def columns_of(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Header names by position: ``*keys, col_no, name, next_same``.

    ``next_same`` is the next position with the same name: of equal names the
    last one present in a row wins.
    """
    cols = tables.select(*keys, F.posexplode("header").alias("_p", "name")).select(
        *keys, (F.col("_p") + 1).alias("col_no"), "name"
    )
    same = Window.partitionBy(*keys, "name").orderBy("col_no")
    return cols.withColumn("next_same", F.lead("col_no").over(same))


def with_columns(raw: DataFrame, tables: DataFrame, block: int = BLOCK) -> DataFrame:
    """Raw rows with the column descriptors of their own table, as array ``columns``.

    ``tables`` may hold several headers of a table (``catalog.upsert_versions``):
    a row gets the one of its own schema. Descriptors are repeated for each block
    of lines and joined on (table, schema, block), so a table of any length
    spreads over many tasks.
    """
    version = [*TABLE, "schema_hash"]
    layout = (
        columns_of(tables.filter("n_rows >= 1"), [*version, "n_rows"])
        .groupBy(*version, "n_rows")
        .agg(F.array_sort(F.collect_list(F.struct("col_no", "name", "next_same"))).alias("columns"))
        .select(*version, "columns", F.explode(F.sequence(F.lit(0).cast("bigint"), block_of(F.col("n_rows") + 1, block))).alias("_blk"))
    )
    return raw.withColumn("_blk", block_of("line_no", block)).join(layout, [*version, "_blk"]).drop("_blk")


def keyed_cells(raw: DataFrame, tables: DataFrame) -> DataFrame:
    """Raw rows as keyed cells: ``file_id, table_name, line_no, schema_hash, col_no, name, kind, num, txt``."""
    return present_cells(with_columns(raw, tables)).select(
        *TABLE, "line_no", "schema_hash", "columns.col_no", "columns.name", "cells.kind", "cells.num",
        cell_text(F.col("cells")).alias("txt"),
    )


def present_cells(rows: DataFrame) -> DataFrame:
    """Cells of rows next to their column descriptors (columns ``cells`` and ``columns``).

    Both arrays are zipped before the explode, so no array is copied per cell.
    """
    others = [c for c in rows.columns if c not in ("cells", "columns")]
    zipped = rows.select(
        *others, F.size("cells").alias("_width"), F.inline(F.arrays_zip("cells", "columns"))
    )
    last = F.col("columns.next_same").isNull() | (F.col("columns.next_same") > F.col("_width"))
    return zipped.filter(F.col("cells").isNotNull() & F.col("columns").isNotNull() & last).drop("_width")


def rows_as_json(raw: DataFrame, tables: DataFrame) -> DataFrame:
    """``file_id, table_name, line_no, schema_hash, row_data``: one JSON object per row, non-ASCII kept."""
    rows = with_columns(raw, tables)
    width = F.size("cells")
    pairs = F.filter(
        F.arrays_zip("cells", "columns"),
        lambda z: z["cells"].isNotNull()
        & z["columns"].isNotNull()
        & (z["columns"]["next_same"].isNull() | (z["columns"]["next_same"] > width)),
    )
    members = F.transform(pairs, lambda z: F.concat(quoted_json(z["columns"]["name"]), F.lit(": "), _json_value(z["cells"])))
    return rows.select(
        *TABLE, "line_no", "schema_hash",
        F.concat(F.lit("{"), F.concat_ws(", ", members), F.lit("}")).alias("row_data"),
    )


def _json_value(cell: Column) -> Column:
    text = cell_text(cell)
    return F.when(cell["kind"] == "number", text).when(cell["kind"] == "bool", F.lower(text)).otherwise(quoted_json(text))


def rows_from_json(rows: DataFrame, column: str = "row_data") -> DataFrame:
    """Decode JSON objects to ``header`` (keys, in order) and ``cells``; other columns are kept.

    Text that isn't a JSON object, or null, has an ``error``, no keys and no cells (empty arrays): an
    ``inline`` drops it, so count it by ``error`` first.
    """
    typed = F.expr(f"from_json({column}, 'map<string,variant>')")
    plain = F.expr(f"from_json({column}, 'map<string,string>')")
    return (
        rows.withColumn("_typed", typed)
        .withColumn("_plain", plain)
        .withColumn("error", F.when(F.col("_typed").isNull(), F.when(F.col(column).isNull(), "no text").otherwise("not a JSON object")))
        .withColumn("_typed", F.coalesce("_typed", F.expr("cast(map() as map<string,variant>)")))
        .withColumn("_plain", F.coalesce("_plain", F.expr("cast(map() as map<string,string>)")))
        .withColumn("header", F.map_keys("_typed"))
        .withColumn("_v", F.map_values("_typed"))
        .withColumn("_s", F.map_values("_plain"))
        .withColumn("cells", F.transform(F.arrays_zip("_v", "_s"), lambda z: _decoded(z["_v"], z["_s"])))
        .drop("_typed", "_plain", "_v", "_s", column)
    )


def _decoded(value: Column, text: Column) -> Column:
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    is_bool = kind == "BOOLEAN"
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.struct(
        F.when(value.isNull() | (kind == "VOID") | ((kind == "STRING") & (text == "")), F.lit("blank"))
        .when(is_bool, F.lit("bool"))
        .when(is_number, F.lit("number"))
        .otherwise(F.lit("text"))
        .alias("kind"),
        F.when(is_number | is_bool, number).alias("num"),
        F.when(is_bool, F.initcap(text))
        .when(is_number & text.rlike("[.eE]"), F.lit(None))
        .otherwise(F.coalesce(text, F.lit("")))
        .alias("txt"),
    )


def non_blank_cells(keyed: DataFrame) -> DataFrame:
    cell = F.struct("kind", "num", "txt")
    return keyed.filter(has_value(cell))
