"""Registered queries: table segmentation, ingest, keyed and JSON rows, sources and sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions.text import cell_of, cell_text
from gridloom.operators import catalog, grid, reshape
from gridloom.operators.blocks import numbered
from gridloom.plans import inputs, readback
from gridloom.plans.inputs import table
from gridloom.plans.readback import CORRECTED_INVERTED_SQL, PART_SQL
from gridloom.plans.workbooks import workbook
from gridloom.sources import files as sources, sinks
from gridloom.sources.workbook import SCHEMA, good_rows, scan_workbooks


def event_grid(spark: SparkSession, folder: str) -> DataFrame:
    """One sheet per user, one row per event in order; an error event is a blank row."""
    return inputs.stored_grid(spark, folder, "event_grid", lambda: _event_grid(table(spark, folder, "events")))


def _event_grid(e: DataFrame) -> DataFrame:
    rows = numbered(e.select(F.col("user_id").alias("file_id"), F.lit("log").alias("sheet"), "event_id", "event_type", "value"),
                    ["file_id", "sheet"], "event_id", "row_no")
    blank = F.col("event_type") == "error"
    string = e.schema["event_type"].dataType
    cells = F.array(
        cell_of(F.when(~blank, F.col("event_type")).otherwise(F.lit("  ")), string),
        cell_of(F.when(~blank, F.col("value")), e.schema["value"].dataType),
    )
    return rows.select("file_id", "sheet", "row_no", cells.alias("cells"))


def segment_tables(spark: SparkSession, folder: str) -> DataFrame:
    return grid.table_extents(event_grid(spark, folder)).select("file_id", "sheet", "table_no", "table_name", "start_row", "end_row")


_RUNS_SQL = """
run as (
  select file_id, min(row_no) as start_row, max(row_no) as end_row, row_number() over (partition by file_id order by min(row_no)) as k
  from (select *, sum(cast(blank as integer)) over (partition by file_id order by row_no) as g from row) where not blank
  group by file_id, g having count(*) >= 3),
extent as (
  select file_id, case when m > 1 then k end as table_no, start_row, end_row
  from (select *, count(*) over (partition by file_id) as m from run) where m > 1
  union all
  select file_id, null, min(row_no), max(row_no) from row
  where file_id not in (select file_id from run group by file_id having count(*) > 1) group by file_id)
"""
SEGMENT_TABLES_SQL = f"""
with row as (
  select user_id as file_id, row_number() over (partition by user_id order by event_id) as row_no, event_type = 'error' as blank from events),
{_RUNS_SQL}
select file_id, 'log' as sheet, cast(table_no as integer) as table_no,
       'log' || coalesce(printf('__T%03d', table_no), '') as table_name, start_row, end_row from extent
"""


def document_grid(spark: SparkSession, folder: str) -> DataFrame:
    """One sheet per document, one row per line, one cell per word; lines of under 60 characters are breaks."""
    return inputs.stored_grid(spark, folder, "document_grid", lambda: _document_grid(table(spark, folder, "documents")))


def _document_grid(d: DataFrame) -> DataFrame:
    line = d.select(F.col("doc_id").alias("file_id"), F.lit("text").alias("sheet"), F.posexplode(F.split("text", "\n")).alias("_i", "line"))
    cell = F.transform(F.split("line", " "), lambda w: F.struct(F.lit("text").alias("kind"), F.lit(None).cast("double").alias("num"), w.alias("txt")))
    none = F.array().cast("array<struct<kind:string,num:double,txt:string>>")
    return line.select(
        "file_id", "sheet", (F.col("_i") + 1).cast("bigint").alias("row_no"), F.when(F.length("line") >= 60, cell).otherwise(none).alias("cells")
    )


_DOC_SQL = f"""
with row as (
  select file_id, i as row_no, lines[i] as line, length(lines[i]) < 60 as blank
  from (select doc_id as file_id, string_split(text, chr(10)) as lines from documents), unnest(range(1, len(lines) + 1)) as r(i)),
{_RUNS_SQL},
named as (select *, 'text' || coalesce(printf('__T%03d', table_no), '') as table_name from extent)
"""


def segment_documents(spark: SparkSession, folder: str) -> DataFrame:
    g = document_grid(spark, folder)
    t = grid.tables(g, grid.table_extents(g))
    return t.select(
        "file_id", "table_name", "start_row", "n_rows", F.col("n_cols").cast("bigint").alias("n_cols"),
        F.concat_ws("|", "header").alias("header"),
    )


SEGMENT_DOCUMENTS_SQL = f"""{_DOC_SQL}
select n.file_id, table_name, start_row, end_row - start_row as n_rows,
       case when blank then 0 else len(string_split(line, ' ')) end as n_cols, case when blank then '' else replace(line, ' ', '|') end as header
from named n join row r on r.file_id = n.file_id and r.row_no = n.start_row"""


def ingest_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows of the segmented documents: lines renumbered, words past the header dropped."""
    g = document_grid(spark, folder)
    raw = grid.raw_rows(g, grid.tables(g, grid.table_extents(g)))
    return raw.select(
        "file_id", "table_name", "line_no", F.size("cells").cast("bigint").alias("n_cells"),
        F.concat_ws(" ", F.transform("cells", lambda c: c["txt"])).alias("words"),
    )


INGEST_DOCUMENTS_SQL = f"""{_DOC_SQL},
head as (
  select n.*, case when blank then 0 else len(string_split(line, ' ')) end as n_cols
  from named n join row r on r.file_id = n.file_id and r.row_no = n.start_row)
select h.file_id, table_name, r.row_no - start_row + 1 as line_no,
       case when blank then 0 else least(n_cols, len(string_split(line, ' '))) end as n_cells,
       case when blank then '' else array_to_string(string_split(line, ' ')[1:n_cols], ' ') end as words
from head h join row r on r.file_id = h.file_id and r.row_no > h.start_row and r.row_no <= h.end_row"""


def _talk(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as sheets with the header role, text, role: even turns have all three cells, odd ones two."""
    c = table(spark, folder, "conversations")
    text = lambda v: F.struct(F.lit("text").alias("kind"), F.lit(None).cast("double").alias("num"), v.alias("txt"))
    two = F.array(text(F.col("role")), text(F.col("text")))
    cells = F.when(F.col("turn") % 2 == 0, F.concat(two, F.array(text(F.upper("role"))))).otherwise(two)
    header = F.array(*[text(F.lit(h)) for h in ("role", "text", "role")])
    body = c.select(F.col("conv_id").alias("file_id"), F.lit("talk").alias("sheet"), (F.col("turn") + 2).alias("row_no"), cells.alias("cells"))
    top = c.select(F.col("conv_id").alias("file_id"), F.lit("talk").alias("sheet")).distinct().select(
        "file_id", "sheet", F.lit(1).cast("bigint").alias("row_no"), header.alias("cells")
    )
    g = body.unionByName(top)
    tables = grid.tables(g, grid.table_extents(g, detect=False))
    return grid.raw_rows(g, tables), tables


def keyed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Of the two columns named role the last present one wins."""
    keyed = grid.keyed_cells(*_talk(spark, folder))
    return keyed.select("file_id", "table_name", "line_no", "col_no", "name", "kind", "txt")


KEYED_ROWS_SQL = """
select conv_id as file_id, 'talk' as table_name, turn + 2 as line_no, cast(2 as integer) as col_no, 'text' as name,
       'text' as kind, text as txt from conversations
union all
select conv_id, 'talk', turn + 2, cast(case when turn % 2 = 0 then 3 else 1 end as integer), 'role', 'text',
       case when turn % 2 = 0 then upper(role) else role end from conversations
"""


def json_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties decoded from JSON objects to typed cells."""
    e = table(spark, folder, "events").select("event_id", F.concat(
        F.substring("props", F.lit(1), F.length("props") - 1), F.lit(', "t": "'), F.col("event_type"), F.lit('", "x": 1.50, "n": null, "ok": true}')
    ).alias("row_data"))
    d = grid.rows_from_json(e).select("event_id", F.inline(F.arrays_zip("header", "cells")))
    c = F.col("cells")
    return d.select("event_id", F.col("header").alias("name"), c["kind"].alias("kind"), c["num"].alias("num"), cell_text(c).alias("txt"))


JSON_ROWS_SQL = """
select event_id, unnest(['k', 't', 'x', 'n', 'ok']) as name, unnest(['number', 'text', 'number', 'blank', 'bool']) as kind,
       unnest([cast(props->>'$.k' as double), null, 1.5, null, 1.0]) as num, unnest([props->>'$.k', event_type, '1.5', '', 'True']) as txt
from events
"""


def json_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties, some cut short, emptied, or no object: rows that can't be decoded stay, with an error and no cells."""
    cut = F.col("event_id") % 7
    props = F.when(cut == 1, F.expr("left(props, length(props) - 1)")).when(cut == 2, F.concat(F.lit("["), "props", F.lit("]"))).when(
        cut == 3, F.lit("")
    ).when(cut == 4, F.lit(None)).otherwise(F.col("props"))
    d = grid.rows_from_json(table(spark, folder, "events").select("event_id", props.alias("row_data")))
    return d.select("event_id", "error", F.size("cells").alias("n_cells"), F.size("header").alias("n_names"))


JSON_ERRORS_SQL = """
select event_id, case when event_id % 7 in (1, 2, 3) then 'not a JSON object' when event_id % 7 = 4 then 'no text' end as error,
       case when event_id % 7 in (1, 2, 3, 4) then 0 else cast(len(json_keys(props)) as integer) end as n_cells,
       case when event_id % 7 in (1, 2, 3, 4) then 0 else cast(len(json_keys(props)) as integer) end as n_names
from events
"""


def json_encode(spark: SparkSession, folder: str) -> DataFrame:
    return grid.rows_as_json(*readback.parts(spark, folder)).select("file_id", "table_name", "line_no", "row_data")


JSON_ENCODE_SQL = f"""with {PART_SQL}
select file_id, p_type as table_name, line_no,
       '{{"Peça Nº": ' || p_partkey || ', "Descrição ' || p_brand || '": "' || p_name || '", "Preço (R$)": '
       || case when file_id % 2 = 0 and line_no = 2 then '"s/ preço"' else cast(p_retailprice as varchar) end
       || ', "Tamanho-médio": ' || case when p_size % 2 = 0 then cast(p_size as varchar) else '""' end || ', "2024": ""}}' as row_data
from line"""


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Customers' names written as text files in a folder per nation, then listed: types and bytes of each folder's files."""

    def write(path: str) -> None:
        c = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("value"))
        c.hint("rebalance", "nation").write.partitionBy("nation").text(path)

    found = sources.list_files(spark, inputs.stored(spark, folder, "named_files", write), extensions=("txt",))
    nation = F.regexp_extract("path", "/nation=([0-9]+)/", 1).cast("bigint")
    return found.groupBy(nation.alias("nation"), F.substring_index("name", ".", -1).alias("kind")).agg(
        F.sum("size").alias("size"), (F.count("mtime") == F.count("*")).alias("has_time")
    )


LIST_FILES_SQL = """
select cast(c_nationkey as bigint) as nation, 'txt' as kind, cast(sum(strlen(c_name) + 1) as bigint) as size, true as has_time
from customer group by c_nationkey"""


def header_change_readback(spark: SparkSession, folder: str) -> DataFrame:
    """Customer sheets whose columns swap in a second version: every row keeps the names of its own header."""
    text = lambda v: F.struct(F.lit("text").alias("kind"), F.lit(None).cast("double").alias("num"), v.alias("txt"))
    c = table(spark, folder, "customer").select((F.col("c_nationkey") + 1).cast("bigint").alias("file_id"), F.lit("Clientes").alias("sheet"), "c_custkey", "c_name")
    values = {"Nome": F.col("c_name"), "Chave": F.col("c_custkey").cast("string")}

    def version(rows: DataFrame, header: list[str]) -> tuple[DataFrame, DataFrame]:
        body = numbered(rows, ["file_id", "sheet"], "c_custkey", "_n").select(
            "file_id", "sheet", (F.col("_n") + 1).alias("row_no"), F.array(*[text(values[h]) for h in header]).alias("cells")
        )
        top = rows.select("file_id", "sheet").distinct().select(
            "file_id", "sheet", F.lit(1).cast("bigint").alias("row_no"), F.array(*[text(F.lit(h)) for h in header]).alias("cells")
        )
        g = body.unionByName(top)
        tables = grid.tables(g, grid.table_extents(g, detect=False))
        return grid.raw_rows(g, tables), tables

    old, old_tables = version(c.filter("c_custkey % 2 = 0"), ["Nome", "Chave"])
    new, new_tables = version(c.filter("c_custkey % 2 = 1"), ["Chave", "Nome"])
    keyed = grid.keyed_cells(old.unionByName(new), catalog.upsert_versions(old_tables, new_tables))
    return keyed.select("file_id", "table_name", "schema_hash", "name", "txt")


HEADER_CHANGE_SQL = """
select cast(c_nationkey + 1 as bigint) as file_id, 'Clientes' as table_name,
       md5(case when c_custkey % 2 = 0 then 'nome|chave' else 'chave|nome' end) as schema_hash,
       unnest(['Nome', 'Chave']) as name, unnest([c_name, cast(c_custkey as varchar)]) as txt from customer"""


def parquet_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The orders file as raw rows, numbered by the reader."""
    raw, header = sources.read_parquet_rows(spark, f"{folder}/orders.parquet", F.lit(1))
    at = {h: F.col("cells")[i] for i, h in enumerate(header)}
    return raw.select(
        "table_name", "line_no", at["o_orderkey"]["num"].cast("bigint").alias("o_orderkey"), at["o_orderdate"]["txt"].alias("day"),
        cell_text(at["o_totalprice"]).alias("price"), at["o_orderstatus"]["kind"].alias("kind"),
    )


PARQUET_ROWS_SQL = """
select 'orders' as table_name, 1 + row_number() over () as line_no, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day,
       cast(o_totalprice as varchar) as price, 'text' as kind from orders
"""


def csv_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as CSV text with a blank line after each error, then read as grids."""

    def write(path: str) -> None:
        e = table(spark, folder, "events")
        quoted = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('""')), F.lit(';"'))
        line = F.concat_ws(";", F.col("event_id").cast("string"), "event_type", F.col("value").cast("decimal(18,2)").cast("string"), quoted)
        tail = F.when(F.col("event_type") == "error", F.concat(line, F.lit("\n"))).otherwise(line)
        e.select(tail.alias("value")).write.text(f"{path}/log.csv")

    path = inputs.stored(spark, folder, "csv", write)
    g = sources.read_csv_grid(spark, path, glob="part-*")
    kept = g.filter(~grid.blank_row(F.col("cells")))
    c = lambda i: F.col("cells")[i]
    rows = kept.select(
        c(0)["num"].cast("bigint").alias("event_id"), c(1)["txt"].alias("event_type"), c(2)["num"].alias("value"), c(3)["txt"].alias("props"),
        F.lit("row").alias("what"),
    )
    shape = g.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("row_no").alias("d"), F.max("row_no").alias("m"))
    total = shape.agg(F.sum("n").alias("event_id"), F.sum("d").cast("double").alias("value"), F.sum("m").cast("string").alias("props")).select(
        "event_id", F.lit("").alias("event_type"), "value", "props", F.lit("rows").alias("what")
    )
    return rows.unionByName(total)


CSV_GRID_SQL = """
select event_id, event_type, cast(cast(value as decimal(18,2)) as double) as value, props || ';' as props, 'row' as what from events
union all
select n, '', cast(n as double), cast(n as varchar), 'rows' from (select count(*) + count(*) filter (event_type = 'error') as n from events)
"""


def csv_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, line breaks and quotes and all, as quoted CSV fields: every text comes back as one cell."""

    def write(path: str) -> None:
        d = table(spark, folder, "documents")
        quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
        d.select(F.concat_ws(";", F.col("doc_id").cast("string"), quoted(F.col("text")), "lang").alias("value")).write.text(f"{path}/documents.csv")

    g = sources.read_csv_grid(spark, inputs.stored(spark, folder, "csv_documents", write), glob="part-*")
    c = lambda i: F.col("cells")[i]["txt"]
    return g.select(c(0).cast("bigint").alias("doc_id"), F.size("cells").cast("bigint").alias("n_cells"), F.md5(c(1).cast("binary")).alias("text_md5"), F.length(c(1)).cast("bigint").alias("n_chars"), c(2).alias("lang"))


CSV_DOCUMENTS_SQL = """
select doc_id, cast(3 as bigint) as n_cells, md5(coalesce(text, '')) as text_md5, length(coalesce(text, '')) as n_chars, lang from documents"""


def _exported(spark: SparkSession, folder: str, fmt: str) -> str:
    def write(path: str) -> None:
        fact, _, _, columns = inputs.star_of_sales(spark, folder)
        values = reshape.named_values(fact, columns)
        sinks.write_sheets(reshape.corrected(values), reshape.sheet_columns(values), path, fmt)

    return inputs.stored(spark, folder, f"export_{fmt}", write)


_EXPORT_SCHEMA = "Cliente string, Saldo string, Data string, Valor string, file_id bigint, sheet string"


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Corrected sheets written as one CSV folder each, then read."""
    path = _exported(spark, folder, "csv")
    return spark.read.schema(_EXPORT_SCHEMA).option("sep", ";").option("header", "true").csv(f"{path}/columns=*")


def parquet_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_EXPORT_SCHEMA).parquet(f"{_exported(spark, folder, 'parquet')}/columns=*")


EXPORTED_SQL = f"""select "Cliente", "Saldo", label as "Data", value as "Valor", file_id, sheet from ({CORRECTED_INVERTED_SQL})"""

_ROWS_PER_BOOK = 500


def _books(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("c_custkey")
    people = [["Código", "Nome", "Saldo", "Ativo", "Desde"]]
    for key, name, balance, nation in zip(pdf["c_custkey"], pdf["c_name"], pdf["c_acctbal"], pdf["c_nationkey"]):
        people.append([int(key), name, float(balance), bool(nation % 2), pd.Timestamp(2020, 1, 1).date() + pd.Timedelta(days=int(nation))])
    stacked = []
    for segment, part in pdf.groupby("c_mktsegment"):
        stacked += [["Segmento", "Nome"], *[[segment, n] for n in part["c_name"]], []]
    content = workbook({"Clientes": people, "Segmentos": stacked})
    return pd.DataFrame({"file_id": [int(pdf["book"].iloc[0])], "content": [content]})


def workbook_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Customers put into workbooks of 500, scanned, segmented and read as raw rows."""
    c = table(spark, folder, "customer").withColumn("book", F.floor(F.col("c_custkey") / _ROWS_PER_BOOK))

    def write(path: str) -> None:
        made = c.groupBy("book").applyInPandas(_books, "file_id bigint, content binary")
        scan_workbooks(made).write.parquet(path)

    g = good_rows(spark.read.schema(SCHEMA).parquet(inputs.stored(spark, folder, "books", write)))
    raw = grid.raw_rows(g, grid.tables(g, grid.table_extents(g, min_rows=2)))
    return raw.select(
        "file_id", grid.parse_sub_table(F.col("table_name"))[0].alias("sheet"), F.transform("cells", cell_text)[0].alias("first"),
        F.transform("cells", cell_text)[1].alias("second"), F.concat_ws("|", F.transform(F.slice("cells", 3, 3), cell_text)).alias("rest"),
        F.concat_ws("|", F.transform("cells", lambda x: x["kind"])).alias("kinds"),
    )


WORKBOOK_SCAN_SQL = """
select cast(c_custkey // 500 as bigint) as file_id, 'Clientes' as sheet, cast(c_custkey as varchar) as first, c_name as second,
       c_acctbal || '|' || case when c_nationkey % 2 = 1 then 'True' else 'False' end || '|' || strftime(date '2020-01-01' + c_nationkey, '%Y-%m-%d') as rest,
       'number|text|number|bool|text' as kinds from customer
union all
select cast(c_custkey // 500 as bigint), 'Segmentos', c_mktsegment, c_name, '', 'text|text' from customer
"""

QUERIES = {
    "segment_tables": (segment_tables, SEGMENT_TABLES_SQL),
    "segment_documents": (segment_documents, SEGMENT_DOCUMENTS_SQL),
    "ingest_documents": (ingest_documents, INGEST_DOCUMENTS_SQL),
    "keyed_rows": (keyed_rows, KEYED_ROWS_SQL),
    "json_rows": (json_rows, JSON_ROWS_SQL),
    "json_errors": (json_errors, JSON_ERRORS_SQL),
    "json_encode": (json_encode, JSON_ENCODE_SQL),
    "list_files": (list_files, LIST_FILES_SQL),
    "header_change_readback": (header_change_readback, HEADER_CHANGE_SQL),
    "parquet_rows": (parquet_rows, PARQUET_ROWS_SQL),
    "csv_grid": (csv_grid, CSV_GRID_SQL),
    "csv_documents": (csv_documents, CSV_DOCUMENTS_SQL),
    "csv_roundtrip": (csv_roundtrip, EXPORTED_SQL),
    "parquet_roundtrip": (parquet_roundtrip, EXPORTED_SQL),
    "workbook_scan": (workbook_scan, WORKBOOK_SCAN_SQL),
}
