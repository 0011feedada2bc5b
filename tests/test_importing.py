"""A folder imported twice, with files of several kinds, changed and broken ones; plans of the read and write paths."""

import os
import re

from pyspark.sql import functions as F

from gridloom.operators import grid
from gridloom.plans.workbooks import workbook
from gridloom.sources import files, importing
from test_grid import make


def texts(spark, out):
    got = {}
    for r in files.read_csv_grid(spark, out, numbers=False, glob="part-*").collect():
        key = re.search(r"/file_id=(\d+)/sheet=([^/]*)/", r.path).groups()
        got.setdefault((int(key[0]), key[1]), []).append((r.row_no, [c.txt for c in r["cells"]]))
    return {k: [cells for _, cells in sorted(v)] for k, v in got.items()}


def test_folder_twice(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / "a.csv").write_text('Loja;01/2031;02/2031\n"x\ny";1;2\nz;;3\n')
    (folder / "b.xlsx").write_bytes(workbook({"S": [["Loja", "01/2031"], ["p", 5]], "Vazia": [["Só"]]}))
    for name in ("c.xlsb", "d.xlsx", "e.parquet"):
        (folder / name).write_bytes(b"nothing")
    (folder / "f.csv").write_text('a;"b"c\n')
    done = {r.name: r for r in importing.import_folder(spark, str(folder), store).collect()}
    assert {n: r.status for n, r in done.items()} == {"a.csv": "ingested", "b.xlsx": "ingested", "c.xlsb": "error", "d.xlsx": "error", "e.parquet": "error", "f.csv": "error"}
    importing.export_folder(spark, store, f"{store}/out1")
    a, b = done["a.csv"].file_id, done["b.xlsx"].file_id
    assert texts(spark, f"{store}/out1") == {
        (a, "a"): [["Loja", "Data", "Valor"], ["x\ny", "jan/31", "1.0"], ["x\ny", "fev/31", "2.0"], ["z", "fev/31", "3.0"]],
        (b, "S"): [["Loja", "Data", "Valor"], ["p", "jan/31", "5.0"]],
    }
    # The CSV has other columns and a line less, the book loses its sheet, the broken file is mended.
    (folder / "a.csv").write_text("Loja;03/2031\nz;9\n")
    (folder / "b.xlsx").write_bytes(workbook({"Vazia": [["Só"]]}))
    (folder / "f.csv").write_text("Nome;Cor\nn;azul\n")
    for name in ("a.csv", "b.xlsx", "f.csv"):
        os.utime(folder / name, (2e9, 2e9))
    done = {r.name: r for r in importing.import_folder(spark, str(folder), store).collect()}
    assert (done["a.csv"].file_id, done["f.csv"].status) == (a, "ingested")
    importing.export_folder(spark, store, f"{store}/out2")
    assert texts(spark, f"{store}/out2") == {
        (a, "a"): [["Loja", "Data", "Valor"], ["z", "mar/31", "9.0"]], (done["f.csv"].file_id, "f"): [["Cor", "Nome"], ["azul", "n"]],
    }


def test_segmentation_reads_the_grid_a_few_times(spark, tmp_path):
    make(spark, {(1, "s"): [["a"], ["b"], [None], ["c"], ["d"]]}).write.parquet(str(tmp_path / "grid"))
    g = spark.read.parquet(str(tmp_path / "grid"))
    rows = grid.raw_rows(g, grid.tables(g, grid.table_extents(g, True, 2)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and len(re.findall(r"\bExchange hashpartitioning", plan)) <= 8


def test_column_types_come_from_a_hash_aggregate(spark, tmp_path):
    from gridloom.operators import star
    from test_star import load

    _, _, v, facts = load(spark, {(1, "s"): [["A", "B"], ["x", 1], [2, "y"]], (2, "s"): [["A", "B"], [3, None]]})
    star.fact(facts).write.parquet(str(tmp_path / "fact"))
    stored = spark.read.parquet(str(tmp_path / "fact"))
    columns = star.dim_column(stored, v)
    assert {r.original_name: r.dtype for r in columns.collect()} == {"A": "text", "B": "number"}
    first = stored.groupBy("column_key", "file_id", "sheet").agg(F.min(2 * F.col("line_no") + F.col("value_text").isNotNull().cast("int")))
    assert "SortAggregate" not in first._jdf.queryExecution().executedPlan().toString()
