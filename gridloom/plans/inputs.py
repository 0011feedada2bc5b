"""Sheets that Spark derives from the given tables, and the SQL that says the same.

``sales``: files are nations, sheets market segments, rows customers, and the
date headers the months with orders (inverted sheets of one common schema).
``event``: files are users, sheets event types; the header names the type, so
there is one schema per event type.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.functions.text import cell_of, fingerprint
from gridloom.operators.blocks import numbered
from gridloom.operators import detect, star
from gridloom.operators.unpivot import rows_of_wide, tables_of_wide, unpivot_rows
from gridloom.session import shared_folder
from gridloom.sources.sinks import GRID, append_raw, read_facts, read_raw, replace_facts


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def money(c: str) -> Column:
    """Exact sum of a money column, as a double."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def months(orders: DataFrame) -> list[str]:
    """MM/yyyy headers from the first to the last order: the column names of the sheet."""
    low, high = orders.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    n = (high.year - low.year) * 12 + high.month - low.month + 1
    return [f"{(low.month - 1 + i) % 12 + 1:02d}/{low.year + (low.month - 1 + i) // 12}" for i in range(n)]


#: Orders to a task of the pivot: a customer's row is a hundred times as wide as an order.
PIVOTED = 1 << 18


def monthly_sales(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Customer × month, a real wide DataFrame; the pivot values are given.

    Sums are combined before they are dealt by customer, to as many tasks as the orders ask for.
    """
    orders = table(spark, folder, "orders")
    headers = months(orders)
    monthly = orders.groupBy("o_custkey", F.date_format("o_orderdate", "MM/yyyy").alias("month")).agg(money("o_totalprice").alias("v"))
    dealt = monthly.repartition(orders.count() // PIVOTED + 1, "o_custkey")
    return dealt.groupBy("o_custkey").pivot("month", headers).agg(F.first("v")), headers


# Layers written in this process, by application, data folder and name.
_written: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, folder: str, name: str, write: Callable[[str], None]) -> str:
    """Path of a layer, written once per application: raw rows and facts are stored tables, not lineage."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _written:
        path = f"{shared_folder(spark, 'gridloom')}/{name}"
        write(path)
        _written[key] = path
    return _written[key]


def stored_grid(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A scanned grid, written once: everything after the scan reads the table, not the files."""
    return spark.read.schema(GRID).parquet(stored(spark, folder, name, lambda path: build().write.parquet(path)))


def layers_of(spark: SparkSession, folder: str, name: str, build) -> tuple[DataFrame, DataFrame]:
    """Stored raw rows and table catalog."""

    def write(path: str) -> None:
        raw, tables = build(spark, folder)
        append_raw(raw, f"{path}/raw")
        tables(read_raw(spark, f"{path}/raw")).write.parquet(f"{path}/tables")

    path = stored(spark, folder, name, write)
    return read_raw(spark, f"{path}/raw"), spark.read.parquet(f"{path}/tables")


def sales(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Raw rows and table catalog of the inverted sales sheets."""
    return layers_of(spark, folder, "sales", build_sales)


def build_sales(spark: SparkSession, folder: str):
    wide, headers = monthly_sales(spark, folder)
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") + 1).cast("bigint").alias("file_id"),
        F.col("c_mktsegment").alias("sheet"), F.col("c_name").alias("Cliente"), F.col("c_acctbal").alias("Saldo"),
    )
    columns = ["Cliente", "Saldo", *headers]
    lines = numbered(customer.join(table(spark, folder, "orders").select("o_custkey"), "o_custkey", "left_semi"),
                     ["file_id", "sheet"], "o_custkey", "_n")
    rows = wide.join(lines.hint("merge"), "o_custkey")  # both may be large, whatever their files' size
    raw = rows_of_wide(rows, F.col("file_id"), F.col("sheet"), F.col("_n") + 1, columns)
    return raw, lambda written: tables_of_wide(written, columns)


def star_of_sales(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stored fact, file, date and column tables of the sales sheets."""

    path = stored(spark, folder, "sales_star", lambda path: write_star(spark, path, *sales(spark, folder), files(spark, folder)))
    dims = [spark.read.parquet(f"{path}/{d}") for d in ("file", "date", "column")]
    return read_facts(spark, f"{path}/fact"), *dims


def write_star(spark: SparkSession, path: str, raw: DataFrame, tables: DataFrame, manifest: DataFrame) -> None:
    """Load a star: the small verdict is written first, then the facts, then dimensions from what is stored."""
    detect.verdict(raw, detect.schemas(tables)).write.parquet(f"{path}/verdict")
    verdict = spark.read.parquet(f"{path}/verdict")
    replace_facts(star.fact(unpivot_rows(raw, detect.layout(verdict), tables)), f"{path}/fact")
    star.dim_file(raw, manifest).write.parquet(f"{path}/file")
    star.dim_date(verdict.filter("is_date")).write.parquet(f"{path}/date")
    star.dim_column(read_facts(spark, f"{path}/fact"), verdict, keep_verdict=True).write.parquet(f"{path}/column")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of the sales files."""
    return table(spark, folder, "nation").select(
        (F.col("n_nationkey") + 1).cast("bigint").alias("file_id"), F.concat("n_name", F.lit(".xlsx")).alias("name")
    )


SALES_SQL = """
sale as (
  select cast(c_nationkey + 1 as bigint) as file_id, c_mktsegment as sheet, c_custkey, c_name, c_acctbal,
         strftime(o_orderdate, '%m/%Y') as header, cast(date_trunc('month', o_orderdate) as date) as month,
         cast(sum(cast(o_totalprice as decimal(18,2))) as double) as v
  from orders join customer on o_custkey = c_custkey group by all),
buyer as (
  select *, cast(1 + row_number() over (partition by file_id, sheet order by c_custkey) as bigint) as line_no
  from (select distinct file_id, sheet, c_custkey, c_name, c_acctbal from sale)),
head as (
  select 'Cliente|Saldo|' || string_agg(strftime(m, '%m/%Y'), '|' order by m) as joined, count(*) + 2 as n_cols
  from (select unnest(generate_series(date_trunc('month', (select min(o_orderdate) from orders)),
                                      (select max(o_orderdate) from orders), interval 1 month)) as m)),
hash as (select md5(lower(joined)) as h, n_cols from head),
early as (select * from buyer order by line_no, file_id, sheet limit 500),
dated as (select distinct header from sale join early using (file_id, sheet, c_custkey)),
fact as (
  select b.file_id, null::integer as date_key, md5(h || '|Cliente') as column_key, h as schema_hash, b.sheet, b.line_no,
         b.c_name as value_text, null::double as value_num, 'Cliente' as name, null::date as month, null::date as any_month
  from buyer b, hash
  union all
  select b.file_id, null, md5(h || '|Saldo'), h, b.sheet, b.line_no, null, b.c_acctbal, 'Saldo', null, null from buyer b, hash
  union all
  select s.file_id, case when d.header is not null then cast(strftime(s.month, '%Y%m%d') as integer) end,
         md5(h || '|' || s.header), h, s.sheet, b.line_no, null, s.v, s.header, case when d.header is not null then s.month end, s.month
  from sale s join buyer b using (file_id, sheet, c_custkey) left join dated d on d.header = s.header, hash)
"""


def events_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Events as lines of (user, type) sheets."""
    events = table(spark, folder, "events").withColumn("file_id", F.col("user_id") + 1).withColumn("sheet", F.col("event_type"))
    return numbered(events, ["file_id", "sheet"], "event_id", "_n").withColumn("line_no", F.col("_n") + 1).drop("_n")


# Headers of the event sheets after the type column, each with what its values are:
# codes, numbers, dates, numbers with one odd word, and nothing at all.
EVENT_HEADERS = ["User", "2024", "01/2024", "02/2024", "03/2024", "2024-01-15"]


def event_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Raw rows and catalog of the event sheets: one schema per event type."""
    return layers_of(spark, folder, "events", build_events)


def event_header(kind: Column) -> Column:
    return F.array(F.concat(F.lit("Type "), kind), *[F.lit(h) for h in EVENT_HEADERS])


def build_events(spark: SparkSession, folder: str):
    e = events_numbered(spark, folder)
    text = {c: e.schema[c].dataType for c in e.columns}
    day = F.date_format("ts", "dd/MM/yyyy")
    odd = F.when(F.col("event_id") % 7 == 0, F.lit("N/D")).otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    string = e.schema["event_type"].dataType
    cells = F.array(
        cell_of(F.col("event_type"), string), cell_of(F.col("user_id"), text["user_id"]), cell_of(F.col("event_type"), string),
        cell_of(F.col("value"), text["value"]), cell_of(day, string), cell_of(odd, string), cell_of(F.lit(None).cast("string"), string),
    )
    rows = e.select(
        "file_id", F.col("sheet").alias("table_name"), "line_no", cells.alias("cells"),
        fingerprint(event_header(F.col("event_type"))).alias("schema_hash"),
    )

    def tables(written: DataFrame) -> DataFrame:
        counted = written.groupBy("file_id", "table_name", "schema_hash").agg(F.count("*").alias("n_rows"))
        return counted.withColumn("header", event_header(F.col("table_name")))

    return rows, tables


EVENT_SQL = """
event as (
  select user_id + 1 as file_id, event_type as sheet, event_id, user_id, event_type, value, ts,
         cast(1 + row_number() over (partition by user_id, event_type order by event_id) as bigint) as line_no,
         md5(lower('Type ' || event_type || '|User|2024|01/2024|02/2024|03/2024|2024-01-15')) as schema_hash,
         strftime(ts, '%d/%m/%Y') as day,
         case when event_id % 7 = 0 then 'N/D' else cast(cast(value as decimal(18,2)) as varchar) end as odd
  from events)
"""


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
