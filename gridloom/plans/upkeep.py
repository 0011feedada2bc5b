"""Registered queries: catalog, audit, counts, cleanup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions.text import fingerprint
from gridloom.operators import catalog, cleanup, layers
from gridloom.plans import inputs, readback
from gridloom.plans.inputs import EVENT_SQL, SALES_SQL, table
from gridloom.plans.readback import PART_SQL
from gridloom.session import shared_folder


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    """Order sheets of customers, one version per year; the header is the months with orders."""
    months = table(spark, folder, "orders").select(
        (F.col("o_custkey") + 1).alias("file_id"), F.year("o_orderdate").alias("version"), F.date_format("o_orderdate", "MM").alias("m")
    ).distinct()
    header = F.concat(F.array(F.lit("Cliente")), F.array_sort(F.collect_list("m")))
    rows = months.groupBy("file_id", "version").agg(header.alias("header"))
    return rows.select(
        "file_id", F.lit("Pedidos").alias("table_name"), "version", "header", fingerprint(F.col("header")).alias("schema_hash")
    )


_VERSIONS_SQL = """
version as (
  select custkey + 1 as file_id, 'Pedidos' as table_name, cast(version as integer) as version, list(m order by m) as header,
         md5('cliente|' || string_agg(m, '|' order by m)) as schema_hash
  from (select distinct o_custkey as custkey, year(o_orderdate) as version, strftime(o_orderdate, '%m') as m from orders) group by all),
change as (
  select *, lag(header) over w as old_header, lag(schema_hash) over w as old_hash from version
  window w as (partition by file_id order by version)),
audit as (
  select file_id, table_name, version, old_hash, schema_hash as new_hash,
         list_filter(header, lambda x: not list_contains(old_header, x)) as added,
         list_filter(old_header, lambda x: not list_contains(header, x)) as removed
  from change where old_hash <> schema_hash)
"""


def _text(c: str):
    return F.concat_ws(",", c).alias(c)


def schema_audit(spark: SparkSession, folder: str) -> DataFrame:
    audit = catalog.history_changes(_versions(spark, folder), "version")
    return audit.select("file_id", "table_name", "version", "old_hash", "new_hash", _text("added"), _text("removed"))


SCHEMA_AUDIT_SQL = f"""with {_VERSIONS_SQL}
select file_id, table_name, version, old_hash, new_hash, array_to_string(added, ',') as added, array_to_string(removed, ',') as removed
from audit"""


def _scan(spark: SparkSession, folder: str, left_out: str, scan_no: int) -> DataFrame:
    """Catalog of one scan: a sheet per customer, its header the months of all orders but those in one status."""
    months = (
        table(spark, folder, "orders")
        .filter(F.col("o_orderstatus") != left_out)
        .select((F.col("o_custkey") + 1).alias("file_id"), F.date_format("o_orderdate", "yyyy-MM").alias("m"))
        .distinct()
    )
    rows = months.groupBy("file_id").agg(F.array_sort(F.collect_list("m")).alias("header"), F.count("*").alias("n_rows"))
    return rows.select(
        "file_id", F.lit("Pedidos").alias("table_name"), "header", fingerprint(F.col("header")).alias("schema_hash"),
        "n_rows", F.lit(scan_no).alias("modified_at"),
    )


_SCANS_SQL = """
month as (select o_custkey + 1 as file_id, o_orderstatus as s, strftime(o_orderdate, '%Y-%m') as m from orders),
old as (select file_id, list(m order by m) as header from (select distinct file_id, m from month where s <> 'P') group by file_id),
new as (select file_id, list(m order by m) as header from (select distinct file_id, m from month where s <> 'F') group by file_id)
"""


def catalog_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Two scans of the same folder: which tables changed, and how."""
    audit = catalog.changes(_scan(spark, folder, "P", 1), _scan(spark, folder, "F", 2))
    return audit.select("file_id", "table_name", "old_hash", "new_hash", _text("added"), _text("removed"))


CATALOG_CHANGES_SQL = f"""with {_SCANS_SQL}
select n.file_id, 'Pedidos' as table_name, md5(array_to_string(o.header, '|')) as old_hash, md5(array_to_string(n.header, '|')) as new_hash,
       array_to_string(list_filter(n.header, lambda x: not list_contains(o.header, x)), ',') as added,
       array_to_string(list_filter(o.header, lambda x: not list_contains(n.header, x)), ',') as removed
from new n join old o on o.file_id = n.file_id and o.header <> n.header"""


def catalog_upsert(spark: SparkSession, folder: str) -> DataFrame:
    merged = catalog.upsert_tables(_scan(spark, folder, "P", 1), _scan(spark, folder, "F", 2))
    return merged.select("file_id", "table_name", "schema_hash", "n_rows", "modified_at", _text("header"))


CATALOG_UPSERT_SQL = f"""with {_SCANS_SQL}
select file_id, 'Pedidos' as table_name, md5(array_to_string(header, '|')) as schema_hash, cast(len(header) as bigint) as n_rows,
       cast(modified_at as integer) as modified_at, array_to_string(header, ',') as header
from (select *, 2 as modified_at from new union all select *, 1 from old where file_id not in (select file_id from new))"""


def latest_schema_changes(spark: SparkSession, folder: str) -> DataFrame:
    versions = _versions(spark, folder)
    audit = catalog.history_changes(versions, "version")
    tables = versions.select("file_id", "table_name").distinct()
    files = table(spark, folder, "customer").select((F.col("c_custkey") + 1).alias("file_id"), F.col("c_name").alias("name"))
    return catalog.latest_changes(audit, tables, files, "version")


LATEST_CHANGES_SQL = f"""with {_VERSIONS_SQL}
select c_name as name, table_name, version, cast(len(added) as integer) as n_added, cast(len(removed) as integer) as n_removed
from audit join customer on c_custkey + 1 = file_id order by version desc, file_id, table_name limit 3"""


def schema_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Event sheets newest first: hash, file, sheet, rows."""
    tables = inputs.event_rows(spark, folder)[1]
    seen = table(spark, folder, "events").groupBy((F.col("user_id") + 1).alias("file_id"), F.col("event_type").alias("table_name")).agg(
        F.max("event_id").alias("modified_at")
    )
    files = tables.select("file_id").distinct().withColumn("name", F.concat(F.lit("user_"), F.col("file_id").cast("string")))
    return catalog.schema_listing(tables.join(seen, ["file_id", "table_name"]), files, "modified_at", distinct=True)


SCHEMA_LISTING_SQL = f"""with {EVENT_SQL}
select schema_hash, 'user_' || file_id as name, sheet as table_name, count(*) as n_rows, max(event_id) as modified_at
from event group by schema_hash, file_id, sheet"""


def _listing(pages: DataFrame, changed) -> DataFrame:
    return pages.select(
        F.substring_index("url", "/", -1).alias("name"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60 + F.when(changed, 1).otherwise(0)).alias("mtime"),
        F.length("html").cast("bigint").alias("size"),
    )


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of two thirds of the pages, refreshed with a later listing of all others and three quarters of these."""
    pages = table(spark, folder, "pages")
    old = _listing(pages.filter("page_id % 3 <> 0"), F.lit(False)).withColumn(
        "page_id", F.substring_index("path", "#", -1).cast("bigint")
    )
    status = F.element_at(F.array(*[F.lit(s) for s in ("scanned", "ingested", "error", "pending")]), (F.col("page_id") % 4 + 1).cast("int"))
    known = old.select(F.col("page_id").alias("file_id"), "name", "path", "mtime", "size", status.alias("status"))
    listing = _listing(pages.filter("page_id % 4 <> 0 or page_id % 3 = 0"), F.col("page_id") % 5 == 0)
    return catalog.refresh(known, listing)


def manifest_upsert(spark: SparkSession, folder: str) -> DataFrame:
    m = manifest(spark, folder)
    n = m.select(F.count_distinct("file_id").alias("n_ids"), F.count("file_id").alias("n_files"))
    whole = m.select("name", "path", F.unix_timestamp("mtime").alias("mtime"), "size", "status")
    check = n.select(
        F.lit("*").alias("name"), F.lit("*").alias("path"), F.col("n_ids").alias("mtime"), F.col("n_files").alias("size"), F.lit("*").alias("status")
    )
    return whole.unionByName(check)


_MANIFEST_SQL = """
page as (
  select page_id, regexp_extract(url, '[^/]*$') as name, url || '#' || page_id as path, cast(1700000000 + page_id * 60 as bigint) as t,
         length(html) as size, page_id % 3 <> 0 as old, page_id % 4 <> 0 or page_id % 3 = 0 as new, page_id % 5 = 0 as changed,
         ['scanned', 'ingested', 'error', 'pending'][page_id % 4 + 1] as status from pages),
manifest as (
  select page_id, name, path, case when new and changed then t + 1 else t end as mtime, size,
         case when not old or (new and changed) then 'pending' else status end as status
  from page where old or new)
"""
MANIFEST_UPSERT_SQL = f"""with {_MANIFEST_SQL}
select name, path, mtime, size, status from manifest
union all select '*', '*', count(*), count(*), '*' from manifest"""


def pending_files(spark: SparkSession, folder: str) -> DataFrame:
    chosen = catalog.with_status(manifest(spark, folder), (catalog.PENDING, catalog.SCANNED))
    return chosen.select("path", "status")


PENDING_SQL = f"with {_MANIFEST_SQL} select path, status from manifest where status in ('pending', 'scanned')"


def status_update(spark: SparkSession, folder: str) -> DataFrame:
    m = manifest(spark, folder)
    outcome = m.filter("status = 'pending'").select("file_id", F.when(F.col("size") % 2 == 0, "ingested").otherwise("error").alias("status"))
    return catalog.set_status(m, outcome).select("path", "status")


STATUS_UPDATE_SQL = f"""with {_MANIFEST_SQL}
select path, case when status <> 'pending' then status when size % 2 = 0 then 'ingested' else 'error' end as status from manifest"""


def tables_of_file(spark: SparkSession, folder: str) -> DataFrame:
    tables = inputs.event_rows(spark, folder)[1]
    return catalog.tables_of_file(tables, 3).select("file_id", "table_name", "schema_hash", "n_rows")


TABLES_OF_FILE_SQL = f"""with {EVENT_SQL}
select file_id, sheet as table_name, schema_hash, count(*) as n_rows from event where file_id = 3 group by all"""


def layer_counts(spark: SparkSession, folder: str) -> DataFrame:
    raw, tables = inputs.sales(spark, folder)
    fact, files, dates, columns = inputs.star_of_sales(spark, folder)
    return layers.layer_counts(
        {"manifest": inputs.files(spark, folder), "tables": tables, "raw": raw, "dim_file": files, "dim_date": dates,
         "dim_column": columns, "fact": fact}
    )


LAYER_COUNTS_SQL = f"""with {SALES_SQL}
select 'manifest' as layer, count(*) as n from nation union all select 'tables', count(distinct (file_id, sheet)) from buyer
union all select 'raw', count(*) from buyer union all select 'dim_file', count(distinct file_id) from buyer
union all select 'dim_date', count(*) from dated union all select 'dim_column', count(distinct column_key) from fact
union all select 'fact', count(*) from fact"""


def schema_count(spark: SparkSession, folder: str) -> DataFrame:
    return layers.schema_count(inputs.event_rows(spark, folder)[1])


SCHEMA_COUNT_SQL = "select count(distinct event_type) as n_schemas from events"


def schema_rows(spark: SparkSession, folder: str) -> DataFrame:
    return layers.rows_per_schema(inputs.event_rows(spark, folder)[0])


SCHEMA_ROWS_SQL = f"with {EVENT_SQL} select schema_hash, count(*) as n from event group by schema_hash"


def raw_by_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows of the part schemas whose hash starts with b."""
    rows = layers.raw_of_schema(readback.parts(spark, folder)[0], "b")
    return rows.select("file_id", "table_name", "line_no", "schema_hash")


RAW_BY_PREFIX_SQL = f"""with {PART_SQL}
select * from (
  select file_id, p_type as table_name, line_no, md5(lower('Peça Nº|Descrição ' || p_brand || '|Preço (R$)|Tamanho-médio|2024')) as schema_hash
  from line) where schema_hash like 'b%'"""


def raw_preview(spark: SparkSession, folder: str) -> DataFrame:
    rows = layers.raw_of_table(inputs.event_rows(spark, folder)[0], 3, "click")
    return rows.select("file_id", "table_name", "line_no", F.col("cells")[3]["num"].alias("value"))


RAW_PREVIEW_SQL = f"""with {EVENT_SQL}
select file_id, sheet as table_name, line_no, value from event where file_id = 3 and sheet = 'click' order by line_no limit 1000"""


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    return readback._reloaded(inputs.star_of_sales(spark, folder)[0])


def cleanup_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    kept = cleanup.dedupe(_copies(spark, folder))
    return kept.select("file_id", "sheet", "line_no", "date_key", "column_key", "load_no", "value_num", "value_text")


CLEANUP_DEDUPE_SQL = f"""with {SALES_SQL}
select file_id, sheet, line_no, date_key, column_key, cast(0 as bigint) as load_no, value_num, value_text from fact"""


def cleanup_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return cleanup.duplicate_groups(_copies(spark, folder)).groupBy("file_id").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_facts"))


CLEANUP_DUPLICATES_SQL = f"""with {SALES_SQL}
select file_id, count(*) as n_groups, cast(2 * count(*) as bigint) as n_facts from fact where line_no % 3 = 0 group by file_id"""


def _event_audit(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        (F.col("user_id") + 1).alias("file_id"), F.col("event_type").alias("table_name"), "event_id", F.col("ts").alias("detected_at")
    )


def cleanup_audit_retention(spark: SparkSession, folder: str) -> DataFrame:
    audit = _event_audit(spark, folder)
    kept = cleanup.retain(audit, [F.desc("detected_at"), F.desc("event_id")], spread=["event_id"])
    return kept.select("file_id", "table_name", "event_id")


CLEANUP_AUDIT_SQL = """
select file_id, table_name, event_id from (
  select user_id + 1 as file_id, event_type as table_name, event_id,
         row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn <= 50
"""


def cleanup_purge(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows that stay: those of the part files, which have no facts here."""
    left = cleanup.purge(readback._all_raw(spark, folder), inputs.star_of_sales(spark, folder)[0])
    return left.select("file_id", "table_name", "line_no")


CLEANUP_PURGE_SQL = f"with {PART_SQL} select file_id, p_type as table_name, line_no from line"


def cleanup_transformed(spark: SparkSession, folder: str) -> DataFrame:
    gone = cleanup.transformed(readback._all_raw(spark, folder), inputs.star_of_sales(spark, folder)[0])
    return gone.select("file_id", "table_name", "line_no")


CLEANUP_TRANSFORMED_SQL = f"with {SALES_SQL} select file_id, sheet as table_name, line_no from buyer"


def cleanup_diagnostic(spark: SparkSession, folder: str) -> DataFrame:
    return cleanup.diagnostic(readback._all_raw(spark, folder), _event_audit(spark, folder), _copies(spark, folder))


CLEANUP_DIAGNOSTIC_SQL = f"""with {SALES_SQL}
select (select count(*) from buyer) as raw_transformed, (select count(*) from events) as audit_total,
       (select count(*) from fact where line_no % 3 = 0) as duplicates"""


def cleanup_stats(spark: SparkSession, folder: str) -> DataFrame:
    return cleanup.stats(readback._all_raw(spark, folder), _event_audit(spark, folder), _copies(spark, folder))


CLEANUP_STATS_SQL = f"""with {SALES_SQL}
select (select count(*) from buyer) as removed_raw,
       (select cast(coalesce(sum(n - 50), 0) as bigint) from (select count(*) as n from events group by user_id, event_type) where n > 50) as removed_audit,
       (select count(*) from fact where line_no % 3 = 0) as removed_duplicates"""


def cleanup_run(spark: SparkSession, folder: str) -> DataFrame:
    """All three cleanings in one run: rows that each removed, as observed, and rows that the written layers hold."""
    path = shared_folder(spark, "cleaned")
    order = [F.desc("detected_at"), F.desc("event_id")]
    raw, audit, fact = readback._all_raw(spark, folder), _event_audit(spark, folder), _copies(spark, folder)
    removed = cleanup.clean(raw, audit, fact, path, order, spread=["event_id"])
    left = layers.layer_counts({n: spark.read.parquet(f"{path}/{n}") for n in ("raw", "audit", "fact")})
    each = F.expr("stack(3, 'raw', removed_raw, 'audit', removed_audit, 'fact', removed_duplicates) as (layer, removed)")
    return removed.select(each).join(left.withColumnRenamed("n", "remaining"), "layer")


CLEANUP_RUN_SQL = f"""with {SALES_SQL},
kept as (select sum(least(n, 50)) as n from (select count(*) as n from events group by user_id, event_type))
select 'raw' as layer, (select count(*) from buyer) as removed, (select count(*) from part) as remaining
union all select 'audit', cast((select count(*) from events) - n as bigint), cast(n as bigint) from kept
union all select 'fact', (select count(*) from fact where line_no % 3 = 0), (select count(*) from fact)"""

QUERIES = {
    "schema_audit": (schema_audit, SCHEMA_AUDIT_SQL),
    "catalog_changes": (catalog_changes, CATALOG_CHANGES_SQL),
    "catalog_upsert": (catalog_upsert, CATALOG_UPSERT_SQL),
    "latest_schema_changes": (latest_schema_changes, LATEST_CHANGES_SQL),
    "schema_listing": (schema_listing, SCHEMA_LISTING_SQL),
    "manifest_upsert": (manifest_upsert, MANIFEST_UPSERT_SQL),
    "pending_files": (pending_files, PENDING_SQL),
    "status_update": (status_update, STATUS_UPDATE_SQL),
    "tables_of_file": (tables_of_file, TABLES_OF_FILE_SQL),
    "layer_counts": (layer_counts, LAYER_COUNTS_SQL),
    "schema_count": (schema_count, SCHEMA_COUNT_SQL),
    "schema_rows": (schema_rows, SCHEMA_ROWS_SQL),
    "raw_by_prefix": (raw_by_prefix, RAW_BY_PREFIX_SQL),
    "raw_preview": (raw_preview, RAW_PREVIEW_SQL),
    "cleanup_dedupe": (cleanup_dedupe, CLEANUP_DEDUPE_SQL),
    "cleanup_duplicates": (cleanup_duplicates, CLEANUP_DUPLICATES_SQL),
    "cleanup_audit_retention": (cleanup_audit_retention, CLEANUP_AUDIT_SQL),
    "cleanup_purge": (cleanup_purge, CLEANUP_PURGE_SQL),
    "cleanup_transformed": (cleanup_transformed, CLEANUP_TRANSFORMED_SQL),
    "cleanup_diagnostic": (cleanup_diagnostic, CLEANUP_DIAGNOSTIC_SQL),
    "cleanup_stats": (cleanup_stats, CLEANUP_STATS_SQL),
    "cleanup_run": (cleanup_run, CLEANUP_RUN_SQL),
}
