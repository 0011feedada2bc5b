"""Segmentation, ingest and the block-wise helpers."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import blocks, grid
from gridloom.plans.workbooks import workbook
from gridloom.sources import files
from gridloom.sources.workbook import failed_files, good_rows, read_workbooks, scan_workbooks

GRID = "file_id bigint, sheet string, row_no bigint, cells array<struct<kind:string,num:double,txt:string>>"


def cell(v):
    if v is None:
        return ("blank", None, "")
    if isinstance(v, (int, float)):
        return ("number", float(v), str(v))
    return ("text", None, v)


def make(spark, sheets):
    rows = [(f, s, i, [cell(v) for v in row]) for (f, s), body in sheets.items() for i, row in enumerate(body, 1)]
    return spark.createDataFrame(rows, GRID)


def groups(rows, least):
    """Brute force: maximal runs of non-blank rows."""
    out, run = [], []
    for i, row in enumerate([*rows, []], 1):
        if all(v is None or str(v).strip() == "" for v in row):
            if len(run) >= least:
                out.append((run[0], run[-1]))
            run = []
        else:
            run.append(i)
    return out


CASES = [
    ([["lote", "peso"], *[[k, k / 2] for k in range(3)]], 3, 1),
    ([["lote"], [8], [9], [None], ["doca"], [6]], 2, 2),
    ([["lote"], [" "], [8], [None], ["doca"]], 2, 0),
    ([["lote", 5], [None, "  "], ["", None], ["doca", 6], [None, None], [7, 7]], 1, 3),
    ([[k] for k in range(6)], 7, 0),
    ([[k] for k in range(6)], 6, 1),
]


@pytest.mark.parametrize("rows, least, n", CASES)
def test_runs_of_the_fixture(spark, rows, least, n):
    found = grid.runs_of_rows(make(spark, {(1, "s"): rows}), least).select("start_row", "end_row").collect()
    assert sorted(map(tuple, found)) == groups(rows, least) and len(found) == n


def test_no_rows_no_runs(spark):
    assert grid.runs_of_rows(make(spark, {(1, "s"): [["x"]]}).limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 3, 7, 1 << 16])
def test_runs_do_not_depend_on_the_block_size(spark, block):
    rng = random.Random(block)
    sheets = {(f, s): [[rng.choice(["a", 1, None, " "])] for _ in range(rng.randint(1, 60))] for f in (1, 2) for s in ("p", "q")}
    g = make(spark, sheets)
    found = sorted(map(tuple, grid.runs_of_rows(g, 2, block).collect()))
    expect = sorted((f, s, k, a, b) for (f, s), rows in sheets.items() for k, (a, b) in enumerate(groups(rows, 2), 1))
    assert found == expect
    extents = grid.table_extents(g, True, 2, block)
    raw = grid.raw_rows(g, grid.tables(g, extents), block).select("file_id", "table_name", "line_no", F.size("cells")).collect()
    lines = []
    for (f, s), rows in sheets.items():
        runs = groups(rows, 2)
        named = [(f"{s}__T{k:03d}", a, b) for k, (a, b) in enumerate(runs, 1)] if len(runs) > 1 else [(s, 1, len(rows))]
        lines += [(f, name, i - a + 1, 1) for name, a, b in named for i in range(a + 1, b + 1)]
    assert sorted(map(tuple, raw)) == sorted(lines)


@pytest.mark.parametrize("block, levels", [(2, 2), (3, 1), (1 << 16, 2), (4, 3)])
def test_running_sum_and_neighbours(spark, block, levels):
    rng = random.Random(1)
    rows = [(k, p, rng.randint(-3, 9)) for k in "ab" for p in rng.sample(range(-20, 200), 60)]
    df = spark.createDataFrame(rows, "k string, p bigint, v int")
    sums = {(r.k, r.p): r.x for r in blocks.running_sum(df, ["k"], "p", F.col("v"), "x", block, levels).collect()}
    follow = {(r.k, r.p): r.x for r in blocks.next_position(df, ["k"], "p", "x", block).collect()}
    before = {(r.k, r.p): r.x for r in blocks.previous_value(df, ["k"], "p", "v", "x", block).collect()}
    for k in "ab":
        mine = sorted(r for r in rows if r[0] == k)
        for i, total in enumerate(itertools.accumulate(v for _, _, v in mine)):
            key = mine[i][:2]
            assert sums[key] == total
            assert follow[key] == (mine[i + 1][1] if i + 1 < len(mine) else None)
            assert before[key] == (mine[i - 1][2] if i else None)


def test_first_rows_is_exact_whatever_the_spread(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i * 37 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, o int, i int")
    for ways in (1, 7):
        found = blocks.first_rows(df, ["k"], [F.col("o"), F.col("i")], 10, ["i"], ways=ways).collect()
        for k in {r[0] for r in rows}:
            expect = sorted((o, i) for kk, o, i in rows if kk == k)[:10]
            assert [(r.o, r.i) for r in sorted((r for r in found if r.k == k), key=lambda r: r.rank)] == expect


def test_policy_and_names(spark):
    stacked = [["R", "01/2025"], ["N", 1], ["S", 2], [], [], ["R", "01/2025"], ["N", 3], ["S", 4], [None], ["lost"]]
    g = make(spark, {(1, "Resumo"): stacked, (1, "One"): [["A"], [None], ["b"], ["c"], ["d"]]})
    t = {r.table_name: r for r in grid.tables(g, grid.table_extents(g)).collect()}
    assert set(t) == {"Resumo__T001", "Resumo__T002", "One"}
    assert (t["One"].n_rows, t["One"].n_cols, t["One"].table_no) == (4, 1, None)
    assert t["Resumo__T001"].schema_hash == t["Resumo__T002"].schema_hash and t["Resumo__T002"].start_row == 6
    off = grid.tables(g, grid.table_extents(g, detect=False)).collect()
    assert {r.table_name for r in off} == {"Resumo", "One"}
    names = spark.createDataFrame([("Resumo__T012",), ("Resumo",), ("a__T1__T002",)], "n string")
    sheet, index = grid.parse_sub_table(F.col("n"))
    assert [tuple(r) for r in names.select(sheet, index).collect()] == [("Resumo", 12), ("Resumo", None), ("a__T1", 2)]


def test_keyed_and_json_rows(spark):
    g = make(spark, {(1, "s"): [["A", "B", "A"], ["x", 1, "last", "dropped"], ["only"], [None, 2.5, "é\"q"]], (2, "empty"): [["A", "B"]]})
    t = grid.tables(g, grid.table_extents(g, detect=False))
    raw = grid.raw_rows(g, t)
    keyed = {(r.line_no, r.name): (r.kind, r.num, r.txt) for r in grid.keyed_cells(raw, t).collect()}
    assert keyed == {
        (2, "A"): ("text", None, "last"), (2, "B"): ("number", 1.0, "1"), (3, "A"): ("text", None, "only"),
        (4, "B"): ("number", 2.5, "2.5"), (4, "A"): ("text", None, 'é"q'),
    }
    encoded = {r.line_no: json.loads(r.row_data) for r in grid.rows_as_json(raw, t).collect()}
    assert encoded == {2: {"B": 1, "A": "last"}, 3: {"A": "only"}, 4: {"B": 2.5, "A": 'é"q'}}
    assert {r.file_id for r in raw.collect()} == {1}


def test_json_decode_keeps_order_and_types(spark):
    source = {"b": 1, "a": "x", "é": 2.5, "t": True, "n": None, "e": "", "z": 1000.0}
    row = grid.rows_from_json(spark.createDataFrame([(json.dumps(source, ensure_ascii=False),)], "row_data string")).first()
    assert row.header == list(source)
    assert [(c.kind, c.num) for c in row.cells] == [
        ("number", 1.0), ("text", None), ("number", 2.5), ("bool", 1.0), ("blank", None), ("blank", None), ("number", 1000.0)
    ]


def test_json_that_is_no_object(spark):
    texts = ['{"a": 1}', '{"a": 1', "[1]", "7", '"x"', "null", "", None, "{}", '{"a": {"b": 2}}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, row_data string")
    got = {r.i: (r.error, r.header, len(r.cells)) for r in grid.rows_from_json(rows).collect()}
    assert [got[i][0] for i in range(10)] == [None, *["not a JSON object"] * 6, "no text", None, None]
    assert all(got[i][1:] == ([], 0) for i in range(1, 9)) and got[0][1:] == (["a"], 1) and got[9][1] == ["a"]


def test_workbooks_from_a_folder(spark, tmp_path):
    from datetime import date

    (tmp_path / "sub").mkdir()
    rows = [["Cliente", date(2025, 1, 10), 2025, None, 0], ["João & <b>", 1, 2.5, True, " "], [], ["x", None, 3]]
    (tmp_path / "a.xlsx").write_bytes(workbook({"Vendas": rows, "Outra": [["só"]]}))
    (tmp_path / "sub" / "b.xlsm").write_bytes(b"not a workbook")
    (tmp_path / "skip.txt").write_text("x")
    listing = files.list_files(spark, str(tmp_path))
    assert {r.name for r in listing.collect()} == {"a.xlsx", "b.xlsm"}
    manifest = listing.withColumn("file_id", F.when(F.col("name") == "a.xlsx", 1).otherwise(2).cast("bigint"))
    scan = read_workbooks(spark, str(tmp_path), manifest)
    assert [r.file_id for r in failed_files(scan).collect()] == [2]
    g = good_rows(scan)
    got = {(r.sheet, r.row_no): [(c.kind, c.txt) for c in r.cells] for r in g.collect()}
    assert got[("Vendas", 1)] == [("text", "Cliente"), ("date", "2025-01-10"), ("number", "2025"), ("blank", ""), ("number", "0")]
    assert got[("Vendas", 2)] == [("text", "João & <b>"), ("number", "1"), ("number", "2.5"), ("bool", "True"), ("text", " ")]
    assert [k for k, _ in got[("Vendas", 3)]] == ["blank"] * 5 and got[("Vendas", 4)][0] == ("text", "x")
    t = {r.table_name: r.header for r in grid.tables(g, grid.table_extents(g)).collect()}
    assert t == {"Vendas": ["Cliente", "2025-01-10", "2025", "", ""], "Outra": ["só"]}


def test_csv_grid_numbers_rows_over_many_splits(spark, tmp_path):
    body = ["﻿A;B", '1;"x;""y"', "", "007;-2.5", "a;;"] + [f"r{i};{i}" for i in range(3000)]
    (tmp_path / "t.csv").write_text("\n".join(body) + "\n", encoding="utf-8")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        rows = sorted(files.read_csv_grid(spark, str(tmp_path)).collect(), key=lambda r: r.row_no)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [r.row_no for r in rows] == list(range(1, len(body) + 1)) and rows[0].sheet == "t"
    got = [[(c.kind, c.txt) for c in r.cells] for r in rows[:5]]
    assert got == [
        [("text", "A"), ("text", "B")], [("number", "1"), ("text", 'x;"y')], [], [("text", "007"), ("number", "-2.5")],
        [("text", "a"), ("blank", ""), ("blank", "")],
    ]
    assert [c.txt for c in rows[-1].cells] == ["r2999", "2999"]


def test_scan_of_content_frames(spark):
    made = spark.createDataFrame([(7, bytearray(workbook({"s": [["A"], [1]]})))], "file_id bigint, content binary")
    assert scan_workbooks(made).count() == 2
