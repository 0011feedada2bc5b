"""Writers: layer tables, and one output per (file, sheet)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridloom.operators.blocks import block_of
from gridloom.operators.grid import SHEET
from gridloom.operators.reshape import project
from gridloom.sources.layer import Layer

LINE = [*SHEET, "line_no"]


# Stored layers. Hashes are hex text, which partition discovery could take for
# numbers, so layers are always read with their schema.
GRID = "file_id bigint, sheet string, row_no bigint, cells array<struct<kind:string,num:double,txt:string>>"
RAW = "file_id bigint, table_name string, line_no bigint, cells array<struct<kind:string,num:double,txt:string>>, schema_hash string"
FACTS = (
    "load_no bigint, file_id bigint, date_key int, column_key string, sheet string, line_no bigint, "
    "value_text string, value_num double, value_date timestamp_ntz, schema_hash string"
)


def raw_layer(spark: SparkSession, path: str) -> Layer:
    return Layer(spark, path, RAW, "table_name")


def fact_layer(spark: SparkSession, path: str) -> Layer:
    return Layer(spark, path, FACTS)


def append_raw(raw: DataFrame, path: str) -> None:
    """Add raw rows to the stored ones."""
    raw_layer(raw.sparkSession, path).load(raw, replace=False)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return raw_layer(spark, path).read()


def replace_raw(raw: DataFrame, path: str, loaded: DataFrame | None = None) -> None:
    """Store raw rows in place of all that ``loaded`` files (``file_id, table_name``) held, or else of the tables in ``raw``; all others stay."""
    raw_layer(raw.sparkSession, path).load(raw, loaded)


def replace_facts(fact: DataFrame, path: str, loaded: DataFrame | None = None) -> None:
    """Store facts in place of all that ``loaded`` files (``file_id, sheet``) held, or else of the sheets in ``fact``; all others stay."""
    fact_layer(fact.sparkSession, path).load(fact, loaded)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return fact_layer(spark, path).read()


def write_sheets(rows: DataFrame, layout: DataFrame, path: str, fmt: str = "csv", as_text: bool = True) -> list[str]:
    """Write corrected rows, one folder per (file, sheet), and return the folders of the column sets.

    ``layout`` is ``file_id, sheet, columns, inverted``. Sheets with equal columns
    go out in one job; only the distinct column sets come to the driver.
    """
    sets = layout.select("columns", "inverted").distinct().orderBy("columns", "inverted").collect()
    out = []
    for i, kind in enumerate(sets):
        same = F.col("columns").eqNullSafe(F.array(*[F.lit(c) for c in kind["columns"]]).cast("array<string>"))
        sheets = layout.filter(same & (F.col("inverted") == kind["inverted"])).select(*SHEET)
        table = project(rows.join(sheets, SHEET, "left_semi"), kind["columns"], kind["inverted"])
        if fmt == "parquet" and as_text:
            table = table.select(*LINE, *[F.col(f"`{c}`").cast("string").alias(c) for c in table.columns if c not in LINE])
        # Equal (file, sheet, block of lines) go to one file; a long sheet becomes several.
        placed = table.repartition(*SHEET, block_of("line_no")).sortWithinPartitions(*LINE).drop("line_no")
        writer = placed.write.mode("overwrite").partitionBy(*SHEET)
        target = f"{path}/columns={i}"
        if fmt == "csv":
            writer.option("sep", ";").option("header", "true").option("emptyValue", "").option("escape", '"').csv(target)
        else:
            writer.parquet(target)
        out.append(target)
    return out


def csv_line(cells: Column, sep: str = ";") -> Column:
    """Cells as one CSV record; those with a separator, quote or line break are quoted."""
    def field(c: Column) -> Column:
        text = F.coalesce(c, F.lit(""))
        return F.when(text.rlike(rf'[{sep}"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.array_join(F.transform(cells, field), sep)


def write_csv_sheets(lines: DataFrame, path: str, sep: str = ";", tasks: int | None = None) -> None:
    """All sheets (``reshape.export_lines``) as CSV in one job, whatever their columns: ``file_id=…/sheet=…/part=…``.

    A part is a block of lines, one file with the sheet's header on top; within
    it lines are in order. One shuffle serves parts, order and writer, in ``tasks``
    (``reshape.export_tasks``) if given: a task sorts its lines unpacked.
    """
    part = block_of("line_no").alias("part")
    order = Window.partitionBy(*SHEET, "part").orderBy("line_no", "nth")
    rows = lines.select(*SHEET, part, "line_no", "nth", csv_line(F.col("header"), sep).alias("_header"), csv_line(F.col("cells"), sep).alias("_line"))
    if tasks:
        rows = rows.repartition(tasks, *SHEET, "part")
    topped = rows.withColumn("value", F.when(F.row_number().over(order) == 1, F.concat("_header", F.lit("\n"), "_line")).otherwise(F.col("_line")))
    topped.select(*SHEET, "part", "value").write.mode("overwrite").partitionBy(*SHEET, "part").text(path)
