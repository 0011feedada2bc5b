"""CSV grids against Python's reader: line breaks in quoted fields, splits anywhere, broken files."""

import csv
import io
import random

import numpy as np
import pytest

from gridloom.sources import files


def texts(spark, folder):
    out = {}
    for r in files.read_csv_grid(spark, str(folder)).orderBy("path", "row_no").collect():
        out.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.row_no, [c.txt for c in r["cells"]]))
    assert all([n for n, _ in rows] == list(range(1, len(rows) + 1)) for rows in out.values())
    return {name: [cells for _, cells in rows] for name, rows in out.items()}


def write(folder, name, rows, end="\n"):
    held = io.StringIO(newline="")
    csv.writer(held, delimiter=";", lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows(rows)
    (folder / name).write_bytes(held.getvalue().encode())


@pytest.mark.parametrize("split", [40, 300, 1 << 27])
def test_fields_with_line_breaks(spark, tmp_path, split):
    rng = random.Random(split)
    word = lambda: "".join(rng.choices('ab;"\n é', weights=[5, 5, 1, 1, 2, 1, 1], k=rng.randint(0, 25)))
    want = {}
    for i in range(6):
        rows = [[word() or "x" for _ in range(rng.randint(1, 4))] for _ in range(rng.choice([1, 30, 80]))]
        rows[0][0] = "\n" * 100 + "long" if i == 0 else rows[0][0]  # over many splits
        want[f"f{i}.csv"] = rows
        write(tmp_path, f"f{i}.csv", rows, "\r\n" if i % 2 else "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert texts(spark, tmp_path) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_plain_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿a;"b;""c""";5" tubo;""\n\n;"";\n;a;b\n;;c\n', encoding="utf-8")
    assert texts(spark, tmp_path)["t.csv"] == [["a", 'b;"c"', '5" tubo', ""], [], ["", "", ""], ["", "a", "b"], ["", "", "c"]]


def test_broken_files_leave_the_others(spark, tmp_path):
    bodies = {"a": 'x;1\n"y\nz";2\n', "b": 'x;1\n"never closed;2\nmore\n', "c": 'a;"b"c;d\n', "d": ""}
    for name, body in bodies.items():
        (tmp_path / f"{name}.csv").write_text(body)
    rows = files.scan_csv(spark, str(tmp_path)).collect()
    failed = {r.sheet for r in rows if r.error}
    assert failed == {"b", "c"}
    assert sorted((r.row_no, [c.txt for c in r["cells"]]) for r in rows if r.sheet == "a") == [(1, ["x", "1"]), (2, ["y\nz", "2"])]
    with pytest.raises(Exception, match="unclosed quoted field"):
        files.read_csv_grid(spark, str(tmp_path)).collect()


def test_effects_compose():
    rng = np.random.default_rng(3)
    effect = rng.integers(0, 4, 500)
    for start in (0, 1):
        now, want = start, []
        for e in effect:
            want.append(now)
            now = [now, 0, 1, 1 - now][e]
        assert files._states(effect, start).tolist() == [*want, now]


def test_very_wide_records(spark, tmp_path):
    (tmp_path / "w.csv").write_text(";".join('"q""q"' for _ in range(20000)) + ';"open\nend"\n')
    (row,) = texts(spark, tmp_path)["w.csv"]
    assert len(row) == 20001 and row[0] == 'q"q' and row[-1] == "open\nend"
