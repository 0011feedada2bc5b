"""Registered queries: header tests, value votes, unpivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions.dates import date_label, header_date, is_date_header
from gridloom.functions.text import fingerprint, header_text, cell_of, number_text
from gridloom.operators import detect, star, unpivot
from gridloom.plans import inputs
from gridloom.plans.inputs import EVENT_SQL, SALES_SQL, money, table


def inverted_orders_monthly(spark: SparkSession, folder: str) -> DataFrame:
    wide, _ = inputs.monthly_sales(spark, folder)
    long = unpivot.unpivot_dates(wide, value="amount")
    return (
        long.groupBy("date")
        .agg(F.count("*").alias("n_customers"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"))
        .select(F.date_format("date", "yyyy-MM-dd").alias("month"), "n_customers", "total")
    )


INVERTED_ORDERS_SQL = """
select strftime(m, '%Y-%m-%d') as month, count(*) as n_customers, cast(sum(v) as double) as total from (
  select o_custkey, date_trunc('month', o_orderdate) as m, sum(cast(o_totalprice as decimal(18,2))) as v
  from orders group by all) group by m
"""

# The header shape of a date, chosen by its year.
_SHAPES = ["dd/MM/yyyy", "MM/yyyy", "yyyy-MM-dd", "yyyy-MM", "yyyy"]


def _shaped(d):
    k = F.year(d) % 5
    out = F.date_format(d, _SHAPES[4])
    for i in range(4):
        out = F.when(k == i, F.date_format(d, _SHAPES[i])).otherwise(out)
    return out


def unpivot_mixed_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Brand × ship date sheets whose headers come in five shapes, unpivoted through the raw rows."""
    item = table(spark, folder, "lineitem").select(
        "l_partkey", _shaped(F.date_trunc("month", "l_shipdate")).alias("header"), "l_extendedprice"
    )
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    cells = item.join(part, "l_partkey").groupBy("p_brand", "header").agg(money("l_extendedprice").alias("v"))
    headers = [r[0] for r in cells.select("header").distinct().orderBy("header").collect()]  # the sheet's column names
    wide = cells.groupBy("p_brand").pivot("header", headers).agg(F.first("v"))
    long = unpivot.unpivot_dates(wide, value="v")
    return long.select("p_brand", "header", F.date_format("date", "yyyy-MM-dd").alias("date"), "v")


MIXED_SQL = """
select p_brand, header,
       case year(m) % 5 when 4 then strftime(m, '%Y-01-01') else strftime(m, '%Y-%m-01') end as date,
       cast(sum(v) as double) as v
from (select p_brand, date_trunc('month', l_shipdate) as m, cast(l_extendedprice as decimal(18,2)) as v,
             case year(l_shipdate) % 5 when 0 then strftime(date_trunc('month', l_shipdate), '%d/%m/%Y')
               when 1 then strftime(l_shipdate, '%m/%Y') when 2 then strftime(date_trunc('month', l_shipdate), '%Y-%m-%d')
               when 3 then strftime(l_shipdate, '%Y-%m') else strftime(l_shipdate, '%Y') end as header
      from lineitem join part on l_partkey = p_partkey)
group by p_brand, header, date
"""


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    shapes = ["dd/MM/yyyy", "dd-MM-yyyy", "MM/yyyy", "MM-yyyy", "yyyy-MM", "yyyy/MM", "yyyy-MM-dd", "yyyy", "MM/yy", "dd/MM/yy", "dd/MM"]
    dated = o.select(F.explode(F.array(*[F.date_format("o_orderdate", s) for s in shapes])).alias("header"))
    p = table(spark, folder, "part")
    words = p.select(F.explode(F.array("p_name", "p_brand", F.col("p_size").cast("string"))).alias("header"))
    keys = o.select(F.explode(F.array("o_orderpriority", F.col("o_orderkey").cast("string"))).alias("header"))
    padded = o.select(F.concat(F.lit(" "), F.date_format("o_orderdate", "MM/yyyy"), F.lit("\t")).alias("header"))
    return inputs.union_all([dated, words, keys, padded]).distinct()


_HEADERS_SQL = """
header as (
  select unnest([strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%d-%m-%Y'), strftime(o_orderdate, '%m/%Y'),
    strftime(o_orderdate, '%m-%Y'), strftime(o_orderdate, '%Y-%m'), strftime(o_orderdate, '%Y/%m'), strftime(o_orderdate, '%Y-%m-%d'),
    strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%m/%y'), strftime(o_orderdate, '%d/%m/%y'), strftime(o_orderdate, '%d/%m'),
    o_orderpriority, cast(o_orderkey as varchar), ' ' || strftime(o_orderdate, '%m/%Y') || chr(9)]) as header from orders
  union
  select unnest([p_name, p_brand, cast(p_size as varchar)]) from part)
"""


def header_date_test(spark: SparkSession, folder: str) -> DataFrame:
    h = F.col("header")
    return _headers(spark, folder).select(
        "header", is_date_header(h).cast("int").alias("is_date"), F.date_format(header_date(h), "yyyy-MM-dd").alias("date")
    )


HEADER_TEST_SQL = f"""
with {_HEADERS_SQL},
clean as (select distinct header, replace(trim(header, ' ' || chr(9)), '/', '-') as h from header)
select header,
  cast(regexp_full_match(h, '\\d{{2}}-\\d{{2}}-\\d{{4}}|\\d{{2}}-\\d{{4}}|\\d{{4}}-\\d{{2}}(-\\d{{2}})?|\\d{{4}}') as integer) as is_date,
  case when regexp_full_match(h, '\\d{{4}}') and h <> '0000' then h || '-01-01'
       when regexp_full_match(h, '\\d{{4}}-\\d{{2}}') then strftime(try_strptime(h || '-01', '%Y-%m-%d'), '%Y-%m-%d')
       when regexp_full_match(h, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then strftime(try_strptime(h, '%Y-%m-%d'), '%Y-%m-%d')
       when regexp_full_match(h, '\\d{{2}}-\\d{{2}}-\\d{{4}}') then strftime(try_strptime(h, '%d-%m-%Y'), '%Y-%m-%d')
       when regexp_full_match(h, '\\d{{2}}-\\d{{4}}') then strftime(try_strptime('01-' || h, '%d-%m-%Y'), '%Y-%m-%d') end as date
from clean
"""


def date_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _headers(spark, folder).select("header", date_label(F.col("header")).alias("label"))


_MONTHS_SQL = "['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez']"
DATE_LABELS_SQL = f"""
with {_HEADERS_SQL}
select distinct header,
  case when regexp_full_match(header, '\\d{{2}}[/-]\\d{{2}}[/-]\\d{{4}}') then header[1:2] || '/' || header[4:5] || '/' || header[7:10]
       when regexp_full_match(header, '\\d{{4}}[/-]\\d{{2}}[/-]\\d{{2}}') then header[9:10] || '/' || header[6:7] || '/' || header[1:4]
       when regexp_full_match(header, '\\d{{2}}[/-]\\d{{4}}') then {_MONTHS_SQL}[cast(header[1:2] as integer)] || '/' || header[6:7]
       when regexp_full_match(header, '\\d{{4}}[/-]\\d{{2}}') then {_MONTHS_SQL}[cast(header[6:7] as integer)] || '/' || header[3:4]
       when regexp_full_match(header, '\\d{{2}}[/-]\\d{{2}}') then header[4:5] || '/' || header[1:2]
       else header end as label
from header
"""


def date_vote_verdict(spark: SparkSession, folder: str) -> DataFrame:
    raw, tables = inputs.event_rows(spark, folder)
    v = detect.verdict(raw, detect.schemas(tables))
    return v.select(
        "schema_hash", F.col("col_no").cast("bigint").alias("col_no"), "name", "hits", "misses", "neutrals",
        F.col("is_date").cast("int").alias("is_date"),
    )


VERDICT_SQL = f"""
with {EVENT_SQL},
ranked as (
  select *, row_number() over (partition by schema_hash order by line_no, file_id, sheet) as rank from event),
cell as (
  select schema_hash, unnest(['2024', '01/2024', '02/2024', '03/2024']) as name,
         unnest([event_type, cast(value as varchar), day, odd]) as txt, rank from ranked where rank <= 500),
seen as (select schema_hash, name, txt, min(rank) as first from cell where trim(txt) <> '' group by all),
picked as (select *, row_number() over (partition by schema_hash, name order by first, txt) as n from seen),
vote as (
  select schema_hash, name,
         case when try_cast(txt as double) is not null then 'n'
              when regexp_full_match(txt, '\\d{{2}}/\\d{{2}}/\\d{{4}}') and try_strptime(txt, '%d/%m/%Y') is not null then 'h'
              else 'm' end as v
  from picked where n <= 5),
tally as (select schema_hash, name, count(*) filter (v = 'h') as hits, count(*) filter (v = 'm') as misses,
                 count(*) filter (v = 'n') as neutrals from vote group by all),
col as (
  select distinct schema_hash, unnest(range(1, 8)) as col_no,
         unnest(['Type ' || event_type, 'User', '2024', '01/2024', '02/2024', '03/2024', '2024-01-15']) as name from event)
select schema_hash, col_no, name, coalesce(hits, 0) as hits, coalesce(misses, 0) as misses, coalesce(neutrals, 0) as neutrals,
  case when hits is null then 0 when hits + misses = 0 then 1 when hits >= 0.7 * (hits + misses) then 1
       when neutrals >= 3 and misses <= 1 then 1 else 0 end as is_date
from col left join tally using (schema_hash, name)
"""


def header_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Typed values as header cells: zero, false and null are empty, timestamps become dates."""
    e = table(spark, folder, "events").withColumn("flag", F.col("event_type") == "error")
    named = [
        header_text(cell_of(F.when(F.col(c).isNotNull(), F.col(c)), e.schema[c].dataType)).alias(f"h_{c}")
        for c in ("user_id", "ts", "event_type", "value", "flag")
    ]
    return e.select("event_id", *named)


HEADER_NORMALISE_SQL = """
select event_id, case when user_id = 0 then '' else cast(user_id as varchar) end as h_user_id, strftime(ts, '%Y-%m-%d') as h_ts,
       event_type as h_event_type, case when value = 0 then '' else cast(value as varchar) end as h_value,
       case when event_type = 'error' then 'True' else '' end as h_flag
from events
"""


def number_rendering(spark: SparkSession, folder: str) -> DataFrame:
    """Doubles of every magnitude as text."""
    i = table(spark, folder, "lineitem")
    return i.select(
        "l_orderkey", "l_linenumber",
        number_text(F.col("l_extendedprice")).alias("price_text"),
        number_text(F.floor(F.col("l_extendedprice")) * 1e6).alias("large_text"),
        number_text(F.col("l_quantity") / 65536.0).alias("small_text"),
        number_text(F.col("l_quantity") * 1e20).alias("huge_text"),
    )


NUMBER_RENDERING_SQL = """
select l_orderkey, l_linenumber, cast(l_extendedprice as varchar) as price_text,
       cast(floor(l_extendedprice) * 1e6 as varchar) as large_text, cast(l_quantity / 65536.0 as varchar) as small_text,
       cast(l_quantity * 1e20 as varchar) as huge_text
from lineitem
"""


def schema_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Sheets of one customer and year; the header is the months with orders."""
    o = table(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.trunc("o_orderdate", "month").alias("m"))
    months = o.distinct().groupBy("o_custkey", "year").agg(
        F.transform(F.array_sort(F.collect_list("m")), lambda m: F.date_format(m, "MM/yyyy")).alias("months")
    )
    header = F.concat(F.array(F.lit("  Cliente"), F.lit(""), F.concat(F.lit("ANO "), F.col("year").cast("string"))), F.col("months"))
    return months.select("o_custkey", "year", F.size(header).cast("bigint").alias("n_cols"), fingerprint(header).alias("schema_hash"))


FINGERPRINT_SQL = """
select o_custkey, cast(year as integer) as year, count(*) + 3 as n_cols,
       md5(lower('cliente||ano ' || year || '|' || string_agg(strftime(m, '%m/%Y'), '|' order by m))) as schema_hash
from (select distinct o_custkey, year(o_orderdate) as year, date_trunc('month', o_orderdate) as m from orders)
group by o_custkey, year
"""

QUERIES = {
    "inverted_orders_monthly": (inverted_orders_monthly, INVERTED_ORDERS_SQL),
    "unpivot_mixed_headers": (unpivot_mixed_headers, MIXED_SQL),
    "header_date_test": (header_date_test, HEADER_TEST_SQL),
    "date_labels": (date_labels, DATE_LABELS_SQL),
    "date_vote_verdict": (date_vote_verdict, VERDICT_SQL),
    "header_normalise": (header_normalise, HEADER_NORMALISE_SQL),
    "number_rendering": (number_rendering, NUMBER_RENDERING_SQL),
    "schema_fingerprint": (schema_fingerprint, FINGERPRINT_SQL),
}
