"""Tasks of bounded size: wide rows are written, keys counted and schemas met in as many tasks as they ask for."""

import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.operators import blocks, cleanup, grid, reshape
from gridloom.plans import inputs
from gridloom.sources import files, layer as layers, sinks
from gridloom.sources.layer import Layer

CELLS = "array<struct<kind:string,num:double,txt:string>>"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_texts_are_packed_and_come_back(spark):
    text, odd = ("text", None, "é"), [("text", None, "a\0b"), ("text", None, None), ("text", 1.0, "x"), ("number", 1.5, None), ("blank", None, ""), None]
    rows = [(0, [text, ("text", None, ""), text]), (1, [("text", None, "")]), (2, []), (3, None)] + [(4 + i, [text, o]) for i, o in enumerate(odd)]
    g = spark.createDataFrame(rows, f"row_no int, cells {CELLS}")
    sent = grid.packed(g)
    assert sorted(r.row_no for r in sent.filter("_texts is not null and cells is null").collect()) == [0, 1]
    back = grid.unpacked(sent)
    assert back.schema["cells"].dataType == g.schema["cells"].dataType
    assert {r.row_no: r.cells for r in back.collect()} == {r.row_no: r.cells for r in g.collect()}


def test_a_schema_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layers, "VALUES", 300)
    stored = Layer(spark, str(tmp_path / "layer"), "file_id bigint, sheet string, line_no bigint, schema_hash string")
    stored.load(spark.range(500).select(F.lit(1).cast("bigint").alias("file_id"), F.lit("s").alias("sheet"), (F.col("id") + 2).alias("line_no"), F.lit("h1").alias("schema_hash")))
    assert len(list((tmp_path / "layer/rows/load=1/bucket=h1").glob("*.parquet"))) > 1
    assert sorted(r.line_no for r in stored.read().collect()) == list(range(2, 502))
    assert sorted(p.name for p in (tmp_path / "layer").iterdir() if not p.name.startswith(".")) == ["ledger", "rows"]


def test_months_are_pivoted_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inputs, "PIVOTED", 2)
    rows = [(1, "1998-01-05", 1.1), (1, "1998-01-06", 2.2), (1, "1998-03-01", 5.0), (2, "1998-02-01", 7.0), (None, "1998-02-01", 3.0), (3, "1998-02-01", None)]
    spark.createDataFrame(rows, "o_custkey bigint, d string, o_totalprice double").withColumn("o_orderdate", F.to_timestamp("d")).write.parquet(f"{tmp_path}/orders.parquet")
    wide, headers = inputs.monthly_sales(spark, str(tmp_path))
    assert headers == ["01/1998", "02/1998", "03/1998"] and "REPARTITION_BY_NUM" in plan(wide)
    assert sorted(map(tuple, wide.collect()), key=str) == sorted([(1, 3.3, None, 5.0), (2, None, 7.0, None), (None, None, 3.0, None), (3, None, None, None)], key=str)


FACT = "load_no bigint, file_id bigint, date_key int, column_key string, sheet string, line_no bigint, value_num double, schema_hash string"


def test_keys_are_counted_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(cleanup, "COUNTED", 4)
    rows = [(0, 1, None, "a", "s", 2, 1.0, "h")] * 9 + [(1, 1, None, "a", "s", 2, 5.0, "h"), (0, 1, 3, "a", "s", 2, 1.0, "h"), (0, None, 3, "a", "s", 2, 1.0, "h"), (1, None, 3, "a", "s", 2, 1.0, "h")]
    found = cleanup.duplicate_groups(spark.createDataFrame(rows, FACT))
    assert "REPARTITION_BY_NUM" in plan(found)
    assert sorted((r.file_id or 0, r.date_key or 0, r.n) for r in found.collect()) == [(0, 3, 2), (1, 0, 10)]


def test_rows_of_a_schema_meet_its_facts_in_many_tasks(spark):
    raw = spark.range(100).select(F.lit(1).cast("bigint").alias("file_id"), F.lit("t").alias("table_name"), F.col("id").alias("line_no"), F.when(F.col("id") < 90, "h").when(F.col("id") < 95, "g").alias("schema_hash"))
    fact = spark.createDataFrame([("h",), ("h",), (None,)], "schema_hash string")
    gone, left = cleanup.transformed(raw, fact), cleanup.purge(raw, fact)
    assert gone.count() == 90 and left.count() == 10 and set(left.columns) == set(raw.columns)
    assert "_way" in plan(gone) and "_way" in plan(left)


def test_records_of_several_lines_leave_in_batches():
    text = [x for i in range(500) for x in (f'"a{i}', f'b";{i}')]
    rows = {"path": ["p"] * 1000, "_start": [0] * 1000, "effect": pa.array([files._TURNS] * 1000, pa.int8()), "value": text, "_inside": [0] * 1000, "_before": [0] * 1000}
    batch = pa.RecordBatch.from_pydict(rows)
    out = list(files._records(iter([batch.slice(0, 501), batch.slice(501)])))
    assert len(out) <= 4
    got = [r for b in out for r in b.to_pylist()]
    assert [(r["row_no"], r["edge"], r["text"]) for r in got] == [(i + 1, False, f'"a{i}\nb";{i}') for i in range(500)]


def test_a_grid_is_not_sent_whole_for_its_headers(spark, tmp_path):
    spark.createDataFrame([(1, "s", i, [("text", None, str(i))]) for i in range(1, 9)], f"file_id bigint, sheet string, row_no bigint, cells {CELLS}").write.parquet(f"{tmp_path}/grid")
    g = spark.read.parquet(f"{tmp_path}/grid")
    found = grid.tables(g, spark.createDataFrame([(1, "s", None, "s", 1, 8)], "file_id bigint, sheet string, table_no int, table_name string, start_row bigint, end_row bigint"))
    assert "BroadcastHashJoin" not in plan(found) and "SortMergeJoin" in plan(found)
    assert [(r.header, r.n_rows) for r in found.collect()] == [(["1"], 7)]


VALUES = "file_id bigint, sheet string, line_no bigint, column_key string, load_no bigint, value_num double, value_text string"


def test_columns_are_sent_to_facts_and_never_facts_to_columns(spark, tmp_path):
    spark.createDataFrame([(1, "s", i, "k", 0, float(i), None) for i in range(2, 50)], VALUES).write.parquet(f"{tmp_path}/fact")
    fact = spark.read.parquet(f"{tmp_path}/fact")
    columns = spark.range(5000).select(F.when(F.col("id") == 0, "k").otherwise(F.uuid()).alias("column_key"), F.format_string("name %1000d", "id").alias("original_name"))
    columns.write.parquet(f"{tmp_path}/column")
    named = reshape.named_values(fact, spark.read.parquet(f"{tmp_path}/column"))
    assert "BroadcastHashJoin [column_key#" in plan(named) and "BuildRight" in plan(named)
    assert sorted(float(r.value) for r in named.collect()) == [float(i) for i in range(2, 50)]


def test_block_totals_come_to_the_rows(spark):
    rows = spark.createDataFrame([("g", i, i % 3) for i in range(0, 40, 2)], "g string, pos bigint, v int")
    summed = blocks.running_sum(rows, ["g"], "pos", F.col("v"), "upto", block=4)
    nearby = blocks.next_position(rows, ["g"], "pos", "after", block=4)
    before = blocks.previous_value(rows, ["g"], "pos", "v", "was", block=4)
    assert not any("BroadcastHashJoin" in plan(df) for df in (summed, nearby, before))
    assert {r.pos: r.upto for r in summed.collect()} == {p: sum(q % 3 for q in range(0, p + 1, 2)) for p in range(0, 40, 2)}


def test_lines_are_put_together_and_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reshape, "LINED", 10)
    monkeypatch.setattr(reshape, "WRITTEN", 10)
    cells = [(1, f"s{s}", i, 0, n, f"{i}{n}", n != "a") for s in range(5) for i in range(2, 8) for n in ("a", "01/2024", "02/2024")]
    values = spark.createDataFrame(cells, "file_id bigint, sheet string, line_no bigint, load_no bigint, name string, value string, is_date boolean")
    made = reshape.lines(values)
    assert made.rdd.getNumPartitions() == 90 // 10 + 1 and made.count() == 30
    raw = spark.createDataFrame([], sinks.RAW)
    tasks = reshape.export_tasks(values, raw)
    assert tasks == 10
    tables = spark.createDataFrame([], "file_id bigint, table_name string, schema_hash string, n_rows bigint, header array<string>")
    sinks.write_csv_sheets(reshape.export_lines(values, raw, tables, reshape.export_layout(values, tables)), f"{tmp_path}/out", tasks=tasks)
    for s in range(5):
        text = "".join(p.read_text() for p in (tmp_path / f"out/file_id=1/sheet=s{s}/part=0").glob("part-*"))
        assert text.splitlines() == ["a;Data;Valor", *[f"{i}a;{m}/24;{i}{n}" for i in range(2, 8) for m, n in (("jan", "01/2024"), ("fev", "02/2024"))]]
