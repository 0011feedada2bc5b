"""Registered queries: files that are loaded again after they changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators import detect, reshape, star
from gridloom.operators.blocks import numbered
from gridloom.operators.unpivot import rows_of_wide, tables_of_wide, unpivot_rows
from gridloom.plans import inputs
from gridloom.plans.inputs import table
from gridloom.sources import importing, sinks
from gridloom.sources.files import read_csv_grid


def _version(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    placed = numbered(rows, ["file_id", "sheet"], "c_custkey", "_n")
    raw = rows_of_wide(placed, F.col("file_id"), F.col("sheet"), F.col("_n") + 1, columns)
    return raw, tables_of_wide(raw, columns)


def _loaded_twice(spark: SparkSession, folder: str) -> str:
    """Path of customer sheets that were loaded, changed and loaded again.

    Files are nations, sheets segments. Second time the first file is left
    alone; the others have a month more and a third of the lines less, their
    sheet BUILDING is empty, and in every other file FURNITURE is gone.
    """

    def write(path: str) -> None:
        c = table(spark, folder, "customer").select(
            "c_custkey", (F.col("c_nationkey") + 1).cast("bigint").alias("file_id"), F.col("c_mktsegment").alias("sheet"),
            F.col("c_name").alias("Cliente"), F.col("c_acctbal").alias("01/2024"), (F.col("c_acctbal") + 1).alias("02/2024"),
        )
        again = c.filter("file_id > 1 and not (file_id % 2 = 0 and sheet = 'FURNITURE')")
        states = [
            (c, ["Cliente", "01/2024"], c),
            (again.filter("c_custkey % 3 > 0 and sheet != 'BUILDING'"), ["Cliente", "01/2024", "02/2024"], again),
        ]
        for number, (rows, columns, listed) in enumerate(states):
            raw, tables = _version(rows, columns)
            sheets = listed.select("file_id", "sheet").distinct()
            sinks.replace_raw(raw, f"{path}/raw", sheets.withColumnRenamed("sheet", "table_name"))
            verdict = detect.verdict(raw, detect.schemas(tables))
            verdict.write.parquet(f"{path}/verdict/load={number}")
            kept = spark.read.parquet(f"{path}/verdict/load={number}")
            sinks.replace_facts(star.fact(unpivot_rows(raw, detect.layout(kept), tables, number)), f"{path}/fact", sheets)

    return inputs.stored(spark, folder, "reloaded", write)


def _named(spark: SparkSession, path: str) -> DataFrame:
    fact = sinks.read_facts(spark, f"{path}/fact")
    verdict = spark.read.parquet(f"{path}/verdict")
    return reshape.named_values(fact, star.dim_column(fact, verdict), sent=reshape.few(verdict))


def changed_file_reload(spark: SparkSession, folder: str) -> DataFrame:
    """Values of each column of each sheet after the second load, with the raw lines: nothing of the first state is left."""
    path = _loaded_twice(spark, folder)
    lines = sinks.read_raw(spark, f"{path}/raw").groupBy("file_id", F.col("table_name").alias("sheet")).agg(F.count("*").alias("n_lines"))
    number = F.col("value").try_cast("decimal(18,2)")
    totals = _named(spark, path).groupBy("file_id", "sheet", "name").agg(F.count("*").alias("n"), F.coalesce(F.sum(number), F.lit(0)).cast("double").alias("total"))
    return totals.join(lines, ["file_id", "sheet"])


_NOW_SQL = """
c as (select cast(c_nationkey + 1 as bigint) as file_id, c_mktsegment as sheet, c_custkey, c_acctbal from customer),
kept as (select * from c where file_id = 1 or (c_custkey % 3 > 0 and sheet <> 'BUILDING' and not (file_id % 2 = 0 and sheet = 'FURNITURE')))
"""
CHANGED_FILE_SQL = f"""with {_NOW_SQL},
cell as (
  select file_id, sheet, 'Cliente' as name, cast(0 as decimal(18,2)) as v from kept
  union all select file_id, sheet, '01/2024', cast(c_acctbal as decimal(18,2)) from kept
  union all select file_id, sheet, '02/2024', cast(c_acctbal + 1 as decimal(18,2)) from kept where file_id > 1)
select file_id, sheet, name, count(*) as n, cast(sum(v) as double) as total, n_lines
from cell join (select file_id, sheet, count(*) as n_lines from kept group by all) using (file_id, sheet) group by all"""


def load_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """What the ledger says of each sheet's loads, with the rows that each load still has in store."""
    layer = sinks.raw_layer(spark, f"{_loaded_twice(spark, folder)}/raw")
    stored = layer.read(history=True).groupBy("file_id", "table_name", "load").agg(F.count("*").alias("n_stored"))
    found = layer.ledger().join(stored, ["file_id", "table_name", "load"], "left")
    return found.select("file_id", F.col("table_name").alias("sheet"), "load", "n_rows", "is_current", F.coalesce("n_stored", F.lit(0)).cast("bigint").alias("n_stored"))


LOAD_LEDGER_SQL = f"""with {_NOW_SQL},
first as (select file_id, sheet, count(*) as n from c group by all),
again as (select file_id, sheet, count(*) filter (c_custkey % 3 > 0 and sheet <> 'BUILDING') as n from c
          where file_id > 1 and not (file_id % 2 = 0 and sheet = 'FURNITURE') group by all)
select file_id, sheet, cast(1 as bigint) as load, n as n_rows, file_id = 1 as is_current, n as n_stored from first
union all select file_id, sheet, 2, n, true, n from again"""

def _folder(spark: SparkSession, folder: str) -> str:
    """Path of a folder of CSV files, one a nation, with a file of each kind that can't be read."""

    def write(path: str) -> None:
        v = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
        c = table(spark, folder, "customer").select(
            F.col("c_nationkey").cast("int").alias("nation"), "c_custkey", F.concat("c_name", F.lit('\n"VIP"')).alias("Cliente"), v.alias("Saldo"),
            F.when(F.col("c_custkey") % 2 == 0, v).alias("03/2024"),
        )
        placed = c.repartition("nation").sortWithinPartitions("nation", "c_custkey").drop("c_custkey")
        placed.write.partitionBy("nation").option("sep", ";").option("header", "true").option("escape", '"').csv(f"{path}/in")
        kinds = {101: "broken.csv", 102: "book.xlsx", 103: "book.xlsb"}
        bad = c.groupBy().agg(F.count("*")).select(F.explode(F.array(*map(F.lit, kinds))).alias("nation"), F.lit('a;"b').alias("value"))
        bad.write.partitionBy("nation").mode("append").text(f"{path}/in")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for nation, name in kinds.items():
            at = hadoop(f"{path}/in/nation={nation}")
            system = at.getFileSystem(spark._jsc.hadoopConfiguration())
            for status in system.listStatus(at):
                system.rename(status.getPath(), hadoop(at, name))
        importing.import_folder(spark, f"{path}/in", f"{path}/store")
        importing.import_folder(spark, f"{path}/in", f"{path}/store")  # nothing is pending: nothing changes

    return f"{inputs.stored(spark, folder, 'imported', write)}/store"


def folder_to_star(spark: SparkSession, folder: str) -> DataFrame:
    """A folder imported in one call: each file's status, and the values of its columns."""
    store = _folder(spark, folder)
    number = F.col("value").try_cast("decimal(18,2)")
    totals = importing.values_of(spark, store).groupBy("file_id", "name", "is_date").agg(F.count("*").alias("n"), F.coalesce(F.sum(number), F.lit(0)).cast("double").alias("total"))
    files = importing.manifest_of(spark, store).select("file_id", F.regexp_extract("path", "/nation=([0-9]+)/", 1).cast("bigint").alias("nation"), "status")
    return files.join(totals, "file_id", "left").drop("file_id")


FOLDER_SQL = """
with c as (select cast(c_nationkey as bigint) as nation, c_custkey, cast(c_acctbal as decimal(18,2)) as v from customer),
cell as (
  select nation, 'Cliente' as name, false as is_date, cast(0 as decimal(18,2)) as v from c
  union all select nation, 'Saldo', false, v from c
  union all select nation, '03/2024', true, v from c where c_custkey % 2 = 0)
select nation, 'ingested' as status, name, is_date, count(*) as n, cast(sum(v) as double) as total from cell group by all
union all select unnest([101, 102, 103]), 'error', null, null, null, null"""


def folder_export(spark: SparkSession, folder: str) -> DataFrame:
    """The imported folder written as CSV and read back."""
    store = _folder(spark, folder)
    out = inputs.stored(spark, folder, "imported_out", lambda path: importing.export_folder(spark, store, path))
    g = read_csv_grid(spark, out, numbers=False, glob="part-*")
    files = importing.manifest_of(spark, store).select("file_id", F.regexp_extract("path", "/nation=([0-9]+)/", 1).cast("bigint").alias("nation"))
    at = F.regexp_extract("path", "/file_id=([0-9]+)/", 1).cast("bigint").alias("file_id")
    rows = g.select(at, "row_no", F.array_join(F.transform("cells", lambda c: c["txt"]), "|").alias("cells"))
    return rows.join(files, "file_id").select("nation", "row_no", "cells")


FOLDER_EXPORT_SQL = """
with c as (
  select cast(c_nationkey as bigint) as nation, c_custkey, c_name || chr(10) || '"VIP"' as name, cast(c_acctbal as varchar) as v,
         count(*) filter (c_custkey % 2 = 0) over (partition by c_nationkey) as dated
  from customer)
select nation, cast(1 as bigint) as row_no, 'Cliente|Saldo' || case when max(dated) > 0 then '|Data|Valor' else '' end as cells from c group by nation
union all
select nation, 1 + row_number() over (partition by nation order by c_custkey), name || '|' || v || case when dated > 0 then '|mar/24|' || v else '' end
from c where c_custkey % 2 = 0 or dated = 0"""

QUERIES = {
    "folder_to_star": (folder_to_star, FOLDER_SQL),
    "folder_export": (folder_export, FOLDER_EXPORT_SQL),
    "changed_file_reload": (changed_file_reload, CHANGED_FILE_SQL),
    "load_ledger": (load_ledger, LOAD_LEDGER_SQL),
}
