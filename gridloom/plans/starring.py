"""Registered queries: star-schema load and its views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions.text import cell_of, fingerprint
from gridloom.operators import cleanup, detect, star, unpivot
from gridloom.operators.grid import TABLE
from gridloom.plans import inputs
from gridloom.plans.inputs import EVENT_SQL, SALES_SQL, table
from gridloom.sources.sinks import read_facts, replace_facts


def load(raw: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detect, unpivot: the verdict and the unpivoted rows of all schemas."""
    verdict = detect.verdict(raw, detect.schemas(tables))
    return verdict, unpivot.unpivot_rows(raw, detect.layout(verdict), tables)


def sales_facts(spark: SparkSession, folder: str) -> DataFrame:
    return load(*inputs.sales(spark, folder))[1]


def fact_of_sales(spark: SparkSession, folder: str) -> DataFrame:
    """The fact table of the sales sheets."""
    f = star.fact(sales_facts(spark, folder))
    return f.select("file_id", "date_key", "column_key", "schema_hash", "sheet", "line_no", "value_text", "value_num")


FACT_OF_SALES_SQL = f"""with {SALES_SQL}
select file_id, date_key, column_key, schema_hash, sheet, line_no, value_text, value_num from fact"""


def purge_then_load(spark: SparkSession, folder: str) -> DataFrame:
    """Two loads of one header: half of the files, then, with their raw rows purged, the rest, twice. Facts of all files stay, once each."""

    def write(path: str) -> None:
        raw, tables = inputs.sales(spark, folder)
        detect.verdict(raw, detect.schemas(tables)).write.parquet(f"{path}/verdict")
        layout = detect.layout(spark.read.parquet(f"{path}/verdict"))
        first = raw.filter("file_id % 2 = 0")
        left = cleanup.purge(first, star.fact(unpivot.unpivot_rows(first, layout, tables))).unionByName(raw.filter("file_id % 2 = 1"))
        for rows in (first, left, left):
            replace_facts(star.fact(unpivot.unpivot_rows(rows, layout, tables)), f"{path}/fact")

    f = read_facts(spark, f"{inputs.stored(spark, folder, 'sales_twice', write)}/fact")
    return f.select("file_id", "date_key", "column_key", "schema_hash", "sheet", "line_no", "value_text", "value_num")


def dim_date(spark: SparkSession, folder: str) -> DataFrame:
    """Dates of order and shipping headers in two shapes."""
    o = table(spark, folder, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("name"))
    s = table(spark, folder, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("name"))
    return star.dim_date(o.unionByName(s).distinct()).withColumn("full_date", F.date_format("full_date", "yyyy-MM-dd"))


DIM_DATE_SQL = """
select cast(strftime(d, '%Y%m%d') as integer) as date_key, strftime(d, '%Y-%m-%d') as full_date, cast(year(d) as integer) as year,
       cast(month(d) as integer) as month, cast(day(d) as integer) as day, cast(quarter(d) as integer) as quarter,
       monthname(d) as month_name, cast(isodow(d) - 1 as integer) as weekday
from (select cast(o_orderdate as date) as d from orders union select cast(date_trunc('month', l_shipdate) as date) from lineitem)
"""


def _part_rows(spark: SparkSession, folder: str):
    """Brand files, type sheets; accented headers; the 'Preço' column holds a word first in some brands."""
    p = inputs.numbered(
        table(spark, folder, "part").withColumn("file_id", F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint")),
        ["file_id", "p_type"], "p_partkey", "_n",
    ).withColumn("line_no", F.col("_n") + 1)
    string = p.schema["p_type"].dataType
    price = F.when(
        (F.col("file_id") % 2 == 0) & (F.col("line_no") == 2), cell_of(F.lit("s/ preço"), string)
    ).otherwise(cell_of(F.col("p_retailprice"), p.schema["p_retailprice"].dataType))
    names = _part_header(F.col("p_brand"))
    cells = F.array(
        cell_of(F.col("p_partkey"), p.schema["p_partkey"].dataType), cell_of(F.col("p_name"), string), price,
        cell_of(F.when(F.col("p_size") % 2 == 0, F.col("p_size")), p.schema["p_size"].dataType), cell_of(F.lit(""), string),
    )
    rows = p.select("file_id", F.col("p_type").alias("table_name"), "line_no", names.alias("header"), cells.alias("cells"))
    rows = rows.withColumn("schema_hash", fingerprint(F.col("header")))

    def tables(written: DataFrame) -> DataFrame:
        counted = written.groupBy(*TABLE, "schema_hash").agg(F.count("*").alias("n_rows"))
        brand = F.concat(F.lit("Brand#"), F.col("file_id").cast("string"))
        return counted.withColumn("header", _part_header(brand))

    return rows.drop("header"), tables


def _part_header(brand):
    fixed = F.concat(F.lit("Descrição "), brand)
    return F.array(F.lit("Peça Nº"), fixed, F.lit("Preço (R$)"), F.lit("Tamanho-médio"), F.lit("2024"))


def dim_column(spark: SparkSession, folder: str) -> DataFrame:
    verdict, rows = load(*inputs.layers_of(spark, folder, "parts", _part_rows))
    return star.dim_column(star.fact(rows), verdict)


DIM_COLUMN_SQL = """
with p as (
  select *, cast(regexp_extract(p_brand, '([0-9]+)', 1) as bigint) as file_id from part),
line as (select *, 1 + row_number() over (partition by file_id, p_type order by p_partkey) as line_no from p),
cell as (
  select file_id, p_type, line_no, p_brand,
         unnest(['Peça Nº', 'Descrição ' || p_brand, 'Preço (R$)', 'Tamanho-médio']) as original_name,
         unnest(['number', 'text', case when file_id % 2 = 0 and line_no = 2 then 'text' else 'number' end,
                 case when p_size % 2 = 0 then 'number' end]) as t
  from line),
typed as (
  select md5(lower('Peça Nº|Descrição ' || p_brand || '|Preço (R$)|Tamanho-médio|2024')) as schema_hash, original_name,
         arg_min(t, (line_no, file_id, p_type)) filter (t is not null) as dtype
  from cell group by all having count(t) > 0)
select md5(schema_hash || '|' || original_name) as column_key, schema_hash, original_name, dtype,
       lower(regexp_replace(strip_accents(replace(original_name, 'º', 'o')), '[^A-Za-z0-9_]', '_', 'g')) as normalized_name
from typed
"""


def fact_typed_values(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers, words and dates of the event sheets, split by type."""
    raw, tables = inputs.event_rows(spark, folder)
    f = load(raw, tables)[1]
    return f.select(
        "file_id", "sheet", "line_no", "name", "date_key", "value_text", "value_num",
        F.date_format("value_date", "yyyy-MM-dd HH:mm:ss").alias("value_date"),
    )


FACT_TYPED_SQL = f"""
with {EVENT_SQL}
select file_id, sheet, line_no, name,
       case name when '01/2024' then 20240101 when '02/2024' then 20240201 when '03/2024' then 20240301 end as date_key,
       txt as value_text, num as value_num, case when name = '02/2024' then strftime(ts, '%Y-%m-%d 00:00:00') end as value_date
from (select file_id, sheet, line_no, ts,
             unnest(['Type ' || event_type, 'User', '2024', '01/2024', '02/2024', '03/2024']) as name,
             unnest([event_type, null, event_type, null, day, odd]) as txt,
             unnest([null, cast(user_id as double), null, value, null, null]) as num from event)
where txt is not null or num is not null
"""


def sub_header_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Sales sheets in which every 50th line repeats the header: those rows stay as text facts."""
    raw, tables = inputs.sales(spark, folder)
    header = tables.select("schema_hash", "header").distinct()
    repeated = raw.filter(F.col("line_no") % 50 == 0).select(*TABLE, F.lit(1_000_000).cast("bigint").alias("_add"), "line_no", "schema_hash")
    as_cells = F.transform(
        "header",
        lambda h: F.struct(F.lit("text").alias("kind"), F.lit(None).cast("double").alias("num"), h.alias("txt")),
    )
    extra = repeated.join(header, "schema_hash").select(
        *TABLE, (F.col("line_no") + F.col("_add")).alias("line_no"), "schema_hash", as_cells.alias("cells")
    )
    f = load(raw.unionByName(extra), tables)[1]
    return f.groupBy("file_id", "sheet", "line_no").agg(
        F.count("*").alias("n"), F.count("date_key").alias("n_dated"), F.count("value_text").alias("n_text"),
        F.count("value_date").alias("n_date_values"),
        F.coalesce(F.sum(F.when(F.col("date_key").isNotNull(), F.col("value_num").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("total"),
    )


SUB_HEADER_SQL = f"""with {SALES_SQL}
select file_id, sheet, line_no, count(*) as n, count(date_key) as n_dated, count(value_text) as n_text, 0 as n_date_values,
       cast(coalesce(sum(case when date_key is not null then cast(value_num as decimal(18,2)) end), 0) as double) as total
from fact group by file_id, sheet, line_no
union all
select file_id, sheet, line_no + 1000000, n_cols, (select count(*) from dated), n_cols, n_cols - 2, 0 from buyer, hash where line_no % 50 = 0
"""


def inverted_mode(spark: SparkSession, folder: str) -> DataFrame:
    raw, tables = inputs.sales(spark, folder)
    f = unpivot.unpivot_inverted(raw, tables, "Cliente")
    return f.select("file_id", "sheet", "line_no", "date_key", "column_key", "name", "value_text", "value_num")


INVERTED_MODE_SQL = f"""with {SALES_SQL}
select file_id, sheet, line_no, cast(strftime(any_month, '%Y%m%d') as integer) as date_key, md5(h || '|Cliente') as column_key,
       'Cliente' as name, value_text, value_num
from fact, hash where any_month is not null"""


def dim_column_inverted(spark: SparkSession, folder: str) -> DataFrame:
    """The column of inverted mode for sales and part sheets together: only the sales' schema has date columns."""
    layers = [inputs.sales(spark, folder), inputs.layers_of(spark, folder, "parts", _part_rows)]
    verdicts = [detect.verdict(raw, detect.schemas(tables)) for raw, tables in layers]
    layout = detect.layout(verdicts[0].unionByName(verdicts[1]))
    return star.dim_column_inverted(layout, "Cliente Nº")


DIM_COLUMN_INVERTED_SQL = f"""with {SALES_SQL}
select md5(h || '|Cliente Nº') as column_key, h as schema_hash, 'Cliente Nº' as original_name, 'cliente_no' as normalized_name, 'text' as dtype
from hash where exists (select 1 from dated)"""


def star_view(spark: SparkSession, folder: str) -> DataFrame:
    """Fact with its three dimensions, by date and column."""
    view = star.star_view(*inputs.star_of_sales(spark, folder))
    return view.select(
        "file_id", "sheet", "line_no", "file_name", "source_uri", F.date_format("full_date", "yyyy-MM-dd").alias("full_date"),
        "month_name", "quarter", "original_name", "normalized_name", "dtype", "value_text", "value_num",
    )


STAR_VIEW_SQL = f"""with {SALES_SQL}
select file_id, sheet, line_no, n_name || '.xlsx' as file_name, 'db://' || file_id as source_uri, strftime(month, '%Y-%m-%d') as full_date,
       monthname(month) as month_name, cast(quarter(month) as integer) as quarter, name as original_name,
       replace(lower(name), '/', '_') as normalized_name, case when value_text is null then 'number' else 'text' end as dtype,
       value_text, value_num
from fact join nation on n_nationkey + 1 = file_id"""


def star_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals per file, year and quarter from the star."""
    view = star.star_view(*inputs.star_of_sales(spark, folder))
    return (
        view.filter("date_key is not null")
        .groupBy("file_name", "year", "quarter")
        .agg(F.count("*").alias("n"), F.sum(F.col("value_num").cast("decimal(18,2)")).cast("double").alias("total"))
    )


STAR_TOTALS_SQL = f"""with {SALES_SQL}
select n_name || '.xlsx' as file_name, cast(year(month) as integer) as year, cast(quarter(month) as integer) as quarter, count(*) as n,
       cast(sum(cast(value_num as decimal(18,2))) as double) as total
from fact join nation on n_nationkey + 1 = file_id where month is not null group by all"""


def uri_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Back from dimension addresses to registered files; addresses of suppliers are no file ids."""
    raw = inputs.sales(spark, folder)[0]
    dims = star.dim_file(raw, inputs.files(spark, folder)).select("source_uri")
    odd = table(spark, folder, "supplier").select(F.concat(F.lit("db://"), "s_name").alias("source_uri"))
    ids = dims.unionByName(odd).select("source_uri", star.uri_file_id(F.col("source_uri")).alias("file_id"))
    return star.name_of(ids, inputs.files(spark, folder), "file_id", "name", star.UNKNOWN_FILE)


URI_LOOKUP_SQL = """
select 'db://' || (c_nationkey + 1) as source_uri, cast(c_nationkey + 1 as bigint) as file_id, n_name || '.xlsx' as name
from (select distinct c_nationkey from customer join orders on o_custkey = c_custkey) join nation on n_nationkey = c_nationkey
union all
select 'db://' || s_name, null, 'desconhecido' from supplier
"""


def dim_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Insert-or-ignore: dates of shipping are added to the dates of orders."""
    o = table(spark, folder, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("name")).distinct()
    s = table(spark, folder, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("name"))
    old = star.dim_date(o).withColumn("origin", F.lit("old"))
    new = star.dim_date(s.distinct()).withColumn("origin", F.lit("new"))
    return star.add_new(old, new, ["date_key"]).select("date_key", "origin", F.date_format("full_date", "yyyy-MM-dd").alias("full_date"))


DIM_UPSERT_SQL = """
with o as (select distinct cast(o_orderdate as date) as d from orders), s as (select distinct cast(l_shipdate as date) as d from lineitem)
select cast(strftime(d, '%Y%m%d') as integer) as date_key, origin, strftime(d, '%Y-%m-%d') as full_date from (
  select d, 'old' as origin from o union all select d, 'new' from s where d not in (select d from o))
"""


def no_fixed_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Schemas without a fixed column: order sheets per year whose only headers are their months."""
    o = table(spark, folder, "orders").select(
        (F.year("o_orderdate") + (F.col("o_custkey") % 3) * 10000).cast("bigint").alias("file_id"), F.trunc("o_orderdate", "month").alias("m"), "o_totalprice", "o_custkey",
    )
    by_month = o.groupBy("file_id", F.date_format("m", "yyyy-MM").alias("header")).agg(inputs.money("o_totalprice").alias("v"))
    cell = F.struct(F.lit("number").alias("kind"), F.col("v").alias("num"), F.lit(None).cast("string").alias("txt"))
    rows = by_month.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("header", cell.alias("cell")))).alias("x"))
    keyed = F.col("file_id") < 10000  # one third of the files have no entity column
    entity = F.struct(F.lit("text").alias("kind"), F.lit(None).cast("double").alias("num"), F.lit("total").alias("txt"))
    heads = F.transform("x", lambda c: c["header"])
    cells = F.transform("x", lambda c: c["cell"])
    rows = rows.select(
        "file_id", F.lit("Totais").alias("table_name"), F.lit(2).cast("bigint").alias("line_no"),
        F.when(keyed, heads).otherwise(F.concat(F.array(F.lit("Linha")), heads)).alias("header"),
        F.when(keyed, cells).otherwise(F.concat(F.array(entity), cells)).alias("cells"),
    ).withColumn("schema_hash", fingerprint(F.col("header")))
    tables = rows.select(*TABLE, "schema_hash", "header", F.lit(1).cast("bigint").alias("n_rows"))
    return detect.without_fixed_columns(detect.verdict(rows.drop("header"), detect.schemas(tables)))


NO_FIXED_SQL = """
select schema_hash, n_columns from (
  select md5(string_agg(strftime(m, '%Y-%m'), '|' order by m)) as schema_hash, count(*) as n_columns
  from (select distinct year(o_orderdate) as y, date_trunc('month', o_orderdate) as m from orders where o_custkey % 3 = 0) group by y)
"""

QUERIES = {
    "fact_of_sales": (fact_of_sales, FACT_OF_SALES_SQL),
    "purge_then_load": (purge_then_load, FACT_OF_SALES_SQL),
    "dim_date": (dim_date, DIM_DATE_SQL),
    "dim_column": (dim_column, DIM_COLUMN_SQL),
    "fact_typed_values": (fact_typed_values, FACT_TYPED_SQL),
    "sub_header_rows": (sub_header_rows, SUB_HEADER_SQL),
    "dim_column_inverted": (dim_column_inverted, DIM_COLUMN_INVERTED_SQL),
    "inverted_mode": (inverted_mode, INVERTED_MODE_SQL),
    "star_view": (star_view, STAR_VIEW_SQL),
    "star_totals": (star_totals, STAR_TOTALS_SQL),
    "uri_lookup": (uri_lookup, URI_LOOKUP_SQL),
    "dim_upsert": (dim_upsert, DIM_UPSERT_SQL),
    "no_fixed_columns": (no_fixed_columns, NO_FIXED_SQL),
}
