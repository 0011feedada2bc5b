"""Registered queries: star back to tables, listings, stacked tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators import layers, reshape
from gridloom.operators.grid import sub_table_name
from gridloom.plans import inputs, starring
from gridloom.plans.inputs import SALES_SQL
from gridloom.sources.files import read_csv_grid
from gridloom.sources.sinks import read_facts, write_csv_sheets

_LABEL_SQL = "['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'][month(any_month)] || '/' || strftime(any_month, '%y')"


def _sales_values(spark: SparkSession, folder: str, dates: str = "name") -> DataFrame:
    fact, _, _, columns = inputs.star_of_sales(spark, folder)
    return reshape.named_values(fact, columns, dates)


def _entities(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*reshape.LINE, *[F.col("entity")[n].alias(n) for n in names], "label", "value")


def value_readback(spark: SparkSession, folder: str) -> DataFrame:
    fact, _, _, columns = inputs.star_of_sales(spark, folder)
    return reshape.ordered_values(fact, columns)


VALUE_READBACK_SQL = f"""with {SALES_SQL}
select file_id, sheet, line_no, name, coalesce(cast(value_num as varchar), value_text) as value from fact"""


def corrected_inverted(spark: SparkSession, folder: str) -> DataFrame:
    return _entities(reshape.corrected_inverted(_sales_values(spark, folder)), "Cliente", "Saldo")


CORRECTED_INVERTED_SQL = f"""with {SALES_SQL}
select file_id, sheet, line_no, c_name as "Cliente", cast(c_acctbal as varchar) as "Saldo", {_LABEL_SQL} as label,
       cast(value_num as varchar) as value
from fact join buyer using (file_id, sheet, line_no) where any_month is not null"""


def corrected_verified(spark: SparkSession, folder: str) -> DataFrame:
    """The same, but only for the columns the load accepted as dates."""
    return _entities(reshape.corrected_inverted(_sales_values(spark, folder, "verified")), "Cliente", "Saldo")


CORRECTED_VERIFIED_SQL = CORRECTED_INVERTED_SQL.replace("where any_month", "where month")


def _reloaded(fact: DataFrame) -> DataFrame:
    """Facts with a second load of every third line, its numbers one higher."""
    again = fact.filter(F.col("line_no") % 3 == 0).withColumn("load_no", F.lit(1).cast("bigint"))
    return fact.unionByName(again.withColumn("value_num", F.col("value_num") + 1))


def corrected_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    fact, _, _, columns = inputs.star_of_sales(spark, folder)
    rows = reshape.corrected_inverted(reshape.named_values(_reloaded(fact), columns))
    return _entities(rows, "Cliente", "Saldo")


CORRECTED_LAST_SQL = f"""with {SALES_SQL}
select file_id, sheet, line_no, c_name as "Cliente", cast(case when line_no % 3 = 0 then c_acctbal + 1 else c_acctbal end as varchar) as "Saldo",
       {_LABEL_SQL} as label, cast(case when line_no % 3 = 0 then value_num + 1 else value_num end as varchar) as value
from fact join buyer using (file_id, sheet, line_no) where any_month is not null"""


def star_of_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Stored facts and columns of the part sheets: one schema per brand, no date column with values."""

    path = inputs.stored(
        spark, folder, "parts_star", lambda path: inputs.write_star(spark, path, *parts(spark, folder), inputs.files(spark, folder))
    )
    return read_facts(spark, f"{path}/fact"), spark.read.parquet(f"{path}/column")


def parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return inputs.layers_of(spark, folder, "parts", starring._part_rows)


def _part_columns(rows: DataFrame) -> DataFrame:
    described = F.concat(F.lit("Descrição Brand#"), F.col("file_id").cast("string"))
    named = {"part_no": F.lit("Peça Nº"), "description": described, "price": F.lit("Preço (R$)"), "size": F.lit("Tamanho-médio")}
    return rows.select(*reshape.LINE, *[F.coalesce(F.col("entity")[k], F.lit("")).alias(n) for n, k in named.items()])


def corrected_normal(spark: SparkSession, folder: str) -> DataFrame:
    fact, columns = star_of_parts(spark, folder)
    return _part_columns(reshape.corrected_normal(reshape.named_values(fact, columns)))


PART_SQL = """
line as (
  select *, cast(regexp_extract(p_brand, '([0-9]+)', 1) as bigint) as file_id,
         cast(1 + row_number() over (partition by p_brand, p_type order by p_partkey) as bigint) as line_no from part)
"""
CORRECTED_NORMAL_SQL = f"""with {PART_SQL}
select file_id, p_type as sheet, line_no, cast(cast(p_partkey as double) as varchar) as part_no, p_name as description,
       case when file_id % 2 = 0 and line_no = 2 then 's/ preço' else cast(p_retailprice as varchar) end as price,
       case when p_size % 2 = 0 then cast(cast(p_size as double) as varchar) else '' end as size
from line"""


def raw_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    return _part_columns(reshape.raw_tables(*parts(spark, folder)))


RAW_REBUILD_SQL = CORRECTED_NORMAL_SQL.replace("cast(cast(p_partkey as double) as varchar)", "cast(p_partkey as varchar)").replace(
    "cast(cast(p_size as double) as varchar)", "cast(p_size as varchar)"
)


def sheet_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Entity columns of each sheet in first-seen order."""
    fact, columns = star_of_parts(spark, folder)
    return reshape.sheet_columns(reshape.named_values(fact, columns)).select(
        "file_id", "sheet", F.concat_ws("|", "columns").alias("columns"), F.col("inverted").cast("int").alias("inverted")
    )


SHEET_COLUMNS_SQL = f"""with {PART_SQL},
cell as (select file_id, p_type as sheet, line_no, unnest(['Peça Nº', 'Descrição ' || p_brand, 'Preço (R$)', 'Tamanho-médio']) as name,
                unnest([true, true, true, p_size % 2 = 0]) as filled from line),
seen as (select file_id, sheet, name, min(line_no) as first_line from cell where filled group by all)
select file_id, sheet, string_agg(name, '|' order by first_line, name) as columns, 0 as inverted from seen group by file_id, sheet"""


def _all_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Raw layer of the sales and the part files; only the sales are in the star."""
    return inputs.sales(spark, folder)[0].unionByName(parts(spark, folder)[0])


def raw_only_sheets(spark: SparkSession, folder: str) -> DataFrame:
    raw = _all_raw(spark, folder).withColumnRenamed("table_name", "sheet")
    return reshape.raw_only(raw, inputs.star_of_sales(spark, folder)[0])


RAW_ONLY_SQL = f"""with {PART_SQL}, {SALES_SQL}
select distinct file_id, p_type as sheet from line except select distinct file_id, sheet from fact"""


def file_sheet_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per file and sheet: facts, and raw rows of sheets that are only raw."""
    fact = inputs.star_of_sales(spark, folder)[0]
    raw = _all_raw(spark, folder).withColumnRenamed("table_name", "sheet")
    counted = layers.rows_per_sheet(raw).join(reshape.raw_only(raw, fact), ["file_id", "sheet"])
    return layers.rows_per_sheet(fact).withColumn("layer", F.lit("fact")).unionByName(counted.withColumn("layer", F.lit("raw")))


FILE_SHEET_SQL = f"""with {PART_SQL}, {SALES_SQL}
select file_id, sheet, count(*) as n, 'fact' as layer from fact group by all
union all
select file_id, p_type, count(*), 'raw' from line group by all"""


def export_set(spark: SparkSession, folder: str) -> DataFrame:
    """Everything to export: corrected sales and the untouched part sheets."""
    sales = reshape.corrected(_sales_values(spark, folder))
    raw, tables = parts(spark, folder)
    originals = reshape.raw_tables(raw, tables)
    only = reshape.raw_only(originals, inputs.star_of_sales(spark, folder)[0])
    out = reshape.export_set(sales, originals, only)
    first = F.coalesce(F.col("entity")["Cliente"], F.col("entity")["Peça Nº"])
    return out.select(*reshape.LINE, "origin", first.alias("first_column"), "label", "value")


EXPORT_SET_SQL = f"""with {PART_SQL}, {SALES_SQL}
select file_id, sheet, line_no, 'fact' as origin, c_name as first_column, {_LABEL_SQL} as label, cast(value_num as varchar) as value
from fact join buyer using (file_id, sheet, line_no) where any_month is not null
union all
select file_id, p_type, line_no, 'raw', cast(p_partkey as varchar), null, null from line"""


def _everything(spark: SparkSession, folder: str) -> str:
    """Path of all sheets as CSV, in one job, of four kinds.

    Sales of every third file are as they are (inverted); of the next they are cut
    into two stacked sub-tables, of the rest they are the one sub-table of their
    sheet. Part files (ids from 1001) have facts where even (no dates: normal),
    else they are only raw.
    """

    def write(path: str) -> None:
        named = F.when(F.col("file_id") % 3 == 1, sub_table_name(F.col("sheet"), (F.col("line_no") % 2 + 1).cast("int"))).when(F.col("file_id") % 3 == 2, sub_table_name(F.col("sheet"), F.lit(1))).otherwise(F.col("sheet"))
        moved = lambda df: df.withColumn("file_id", F.col("file_id") + 1000)
        fact, columns = star_of_parts(spark, folder)
        normal = moved(reshape.named_values(fact.filter("file_id % 2 = 0"), columns))
        values = _sales_values(spark, folder).withColumn("sheet", named).unionByName(normal)
        raw, tables = (moved(df) for df in parts(spark, folder))
        layout = reshape.export_layout(values, tables)
        write_csv_sheets(reshape.export_lines(values, raw, tables, layout), path, tasks=reshape.export_tasks(values, raw))

    return inputs.stored(spark, folder, "everything", write)


def export_everything(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of every sheet's CSV file, headers too, read back as text."""
    g = read_csv_grid(spark, _everything(spark, folder), numbers=False, glob="part-*")
    at = lambda name: F.url_decode(F.regexp_extract("path", f"/{name}=([^/]*)/", 1))
    return g.select(at("file_id").cast("bigint").alias("file_id"), at("sheet").alias("sheet"), "row_no", F.array_join(F.transform("cells", lambda c: c["txt"]), "|").alias("cells"))


EXPORT_EVERYTHING_SQL = f"""with {PART_SQL}, {SALES_SQL},
dated_line as (
  select file_id, sheet, case when file_id % 3 = 1 then line_no % 2 + 1 else 0 end as sub, line_no, name,
         c_name || '|' || cast(c_acctbal as varchar) || '|' || {_LABEL_SQL} || '|' || cast(value_num as varchar) as cells
  from fact join buyer using (file_id, sheet, line_no) where any_month is not null),
placed as (select *, row_number() over (partition by file_id, sheet, sub order by line_no, name) as n from dated_line),
subs as (select file_id, sheet, count(distinct sub) as k, min(sub) as one from placed group by all),
sale_line as (
  select file_id, sheet, 1 + n as row_no, p.cells from placed p join subs using (file_id, sheet) where k = 1
  union all
  select file_id, sheet, 1 + g.n, coalesce(a.cells, '|||') || '|' || coalesce(b.cells, '|||')
  from (select distinct file_id, sheet, n from placed join subs using (file_id, sheet) where k = 2) g
  left join (select * from placed where sub = 1) a using (file_id, sheet, n) left join (select * from placed where sub = 2) b using (file_id, sheet, n)),
filled as (select file_id, p_type, max(p_size % 2 = 0) as sized, min(line_no) filter (p_size % 2 = 0) as first_size from line group by all),
part_line as (
  select file_id + 1000 as file_id, p_type as sheet, line_no as row_no,
    case when file_id % 2 = 0 then p_name || '|' || cast(cast(p_partkey as double) as varchar) else cast(p_partkey as varchar) || '|' || p_name end || '|'
    || case when file_id % 2 = 0 and line_no = 2 then 's/ preço' else cast(p_retailprice as varchar) end
    || case when file_id % 2 = 1 then '|' || case when p_size % 2 = 0 then cast(p_size as varchar) else '' end || '|'
            when sized then '|' || case when p_size % 2 = 0 then cast(cast(p_size as double) as varchar) else '' end else '' end as cells
  from line join filled using (file_id, p_type)),
top as (
  select file_id, sheet, case when k = 2 then 't1_Cliente|t1_Saldo|t1_Data|t1_Valor|t2_Cliente|t2_Saldo|t2_Data|t2_Valor' else 'Cliente|Saldo|Data|Valor' end as cells from subs
  union all
  select file_id + 1000, p_type, case when file_id % 2 = 1 then 'Peça Nº|Descrição Brand#' || file_id || '|Preço (R$)|Tamanho-médio|2024'
    else (select string_agg(c, '|' order by l, c) from (values ('Descrição Brand#' || file_id, 2), ('Peça Nº', 2), ('Preço (R$)', 2), ('Tamanho-médio', first_size)) t(c, l) where l is not null) end
  from filled)
select file_id, sheet, cast(1 as bigint) as row_no, cells from top
union all select file_id, sheet, row_no, cells from sale_line
union all select file_id, sheet, row_no, cells from part_line"""


def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    fact, files, _, _ = inputs.star_of_sales(spark, folder)
    return layers.files_with_facts(fact, files)


FILE_LISTING_SQL = f"""with {SALES_SQL}
select distinct file_id as file_key, n_name || '.xlsx' as name from fact join nation on n_nationkey + 1 = file_id"""


def sheet_listing(spark: SparkSession, folder: str) -> DataFrame:
    return layers.sheets_of_files(inputs.star_of_sales(spark, folder)[0])


SHEET_LISTING_SQL = f"with {SALES_SQL} select distinct file_id, sheet from fact"


def column_listing(spark: SparkSession, folder: str) -> DataFrame:
    fact, _, _, columns = inputs.star_of_sales(spark, folder)
    return layers.columns_of_sheets(fact, columns)


COLUMN_LISTING_SQL = f"with {SALES_SQL} select distinct file_id, sheet, name as original_name from fact"


def stack_side_by_side(spark: SparkSession, folder: str) -> DataFrame:
    """Every sheet cut into three stacked sub-tables (by line), then aligned side by side."""
    fact, _, _, columns = inputs.star_of_sales(spark, folder)
    stacked = fact.withColumn("sheet", sub_table_name(F.col("sheet"), (F.col("line_no") % 3 + 1).cast("int")))
    aligned = reshape.aligned(reshape.named_values(stacked, columns))
    return reshape.side_by_side(aligned, {i: ["Cliente", "Saldo"] for i in (1, 2, 3)})


_SIDES = ", ".join(
    f"""coalesce(max(c_name) filter (sub = {i}), '') as "t{i}_Cliente", coalesce(max(saldo) filter (sub = {i}), '') as "t{i}_Saldo", coalesce(max(label) filter (sub = {i}), '') as "t{i}_Data",
        coalesce(max(v) filter (sub = {i}), '') as "t{i}_Valor" """
    for i in (1, 2, 3)
)
STACK_SQL = f"""with {SALES_SQL},
placed as (
  select file_id, sheet, line_no % 3 + 1 as sub, c_name, cast(c_acctbal as varchar) as saldo, {_LABEL_SQL} as label, cast(value_num as varchar) as v,
         row_number() over (partition by file_id, sheet, line_no % 3 order by line_no, name) as position
  from fact join buyer using (file_id, sheet, line_no) where any_month is not null)
select file_id, sheet, position, {_SIDES} from placed group by file_id, sheet, position"""

QUERIES = {
    "value_readback": (value_readback, VALUE_READBACK_SQL),
    "corrected_inverted": (corrected_inverted, CORRECTED_INVERTED_SQL),
    "corrected_verified": (corrected_verified, CORRECTED_VERIFIED_SQL),
    "corrected_last_wins": (corrected_last_wins, CORRECTED_LAST_SQL),
    "corrected_normal": (corrected_normal, CORRECTED_NORMAL_SQL),
    "raw_rebuild": (raw_rebuild, RAW_REBUILD_SQL),
    "sheet_columns": (sheet_columns, SHEET_COLUMNS_SQL),
    "raw_only_sheets": (raw_only_sheets, RAW_ONLY_SQL),
    "file_sheet_counts": (file_sheet_counts, FILE_SHEET_SQL),
    "export_set": (export_set, EXPORT_SET_SQL),
    "export_everything": (export_everything, EXPORT_EVERYTHING_SQL),
    "file_listing": (file_listing, FILE_LISTING_SQL),
    "sheet_listing": (sheet_listing, SHEET_LISTING_SQL),
    "column_listing": (column_listing, COLUMN_LISTING_SQL),
    "stack_side_by_side": (stack_side_by_side, STACK_SQL),
}
