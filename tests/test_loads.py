"""Layers over more than one load: other files' rows stay, rows keep the header of their time; nothing is cut silently."""

from pyspark.sql import functions as F

from gridloom.operators import catalog, grid, reshape, star
from gridloom.sources import sinks
from test_grid import make
from test_star import load


def test_second_load_of_one_header_keeps_the_first_file(spark, tmp_path):
    path = str(tmp_path / "fact")
    for file_id, amount in ((1, 10), (2, 20), (2, 30)):
        _, _, _, facts = load(spark, {(file_id, "s"): [["Loja", "03/2031"], [f"l{file_id}", amount]]})
        sinks.replace_facts(star.fact(facts), path)
    got = sinks.read_facts(spark, path).filter("value_num is not null").select("file_id", "value_num").collect()
    assert sorted(map(tuple, got)) == [(1, 10.0), (2, 30.0)]
    assert [p.name for p in tmp_path.iterdir()] == ["fact"]


def test_purge_of_raw_rows_then_second_load(spark, tmp_path):
    raw_path, path = str(tmp_path / "raw"), str(tmp_path / "fact")
    for file_id in (1, 2):
        raw, _, _, facts = load(spark, {(file_id, "s"): [["Loja", "03/2031"], ["x", file_id]]})
        sinks.replace_raw(raw, raw_path)
        sinks.replace_raw(raw, raw_path)
        assert sinks.read_raw(spark, raw_path).filter(F.col("file_id") == file_id).count() == 1
        sinks.replace_facts(star.fact(facts), path)
        sinks.read_raw(spark, raw_path).limit(0).write.mode("overwrite").parquet(str(tmp_path / "purged"))
    assert sinks.read_facts(spark, path).select("file_id").distinct().count() == 2


def test_rows_keep_the_names_of_their_header(spark):
    def version(header, row):
        g = make(spark, {(1, "s"): [header, row]})
        t = grid.tables(g, grid.table_extents(g, detect=False))
        return grid.raw_rows(g, t), t

    raw1, t1 = version(["Alfa", "Beta"], ["a1", "b1"])
    raw2, t2 = version(["Beta", "Alfa"], ["b2", "a2"])
    both = catalog.upsert_versions(t1, t2)
    assert sorted(r.is_current for r in both.collect()) == [False, True]
    cells = grid.keyed_cells(raw1.unionByName(raw2), both).select("name", "txt").collect()
    assert sorted(map(tuple, cells)) == [("Alfa", "a1"), ("Alfa", "a2"), ("Beta", "b1"), ("Beta", "b2")]


def test_stacked_tables_without_dates_stay(spark):
    _, _, v, facts = load(spark, {(1, "S__T001"): [["P", "Q"], ["a", "b"], ["c", "d"]], (1, "S__T002"): [["P", "Q"], ["e", "f"]]})
    values = reshape.named_values(star.fact(facts), star.dim_column(star.fact(facts), v))
    rows = sorted((r.table_no, r.position, tuple(sorted(r.entity.items()))) for r in reshape.aligned(values).collect())
    assert rows == [(1, 1, (("P", "a"), ("Q", "b"))), (1, 2, (("P", "c"), ("Q", "d"))), (2, 1, (("P", "e"), ("Q", "f")))]
    side = reshape.side_by_side(reshape.aligned(values), {1: ["P", "Q"], 2: ["P"]}).orderBy("position").collect()
    assert [(r.t1_P, r.t1_Q, r.t2_P) for r in side] == [("a", "b", "e"), ("c", "d", "")]


def test_unnamed_sub_table_is_an_error(spark):
    import pytest

    _, _, v, facts = load(spark, {(1, "S__T001"): [["P"], ["a"]], (1, "S__T002"): [["P"], ["b"]]})
    values = reshape.named_values(star.fact(facts), star.dim_column(star.fact(facts), v))
    with pytest.raises(Exception, match="no columns given for sub-table 2"):
        reshape.side_by_side(reshape.aligned(values), {1: ["P"]}).collect()


def test_verified_dates_hold_for_impossible_months(spark):
    _, _, v, facts = load(spark, {(1, "s"): [["Loja", "77/2031"], ["x", 5]]})
    columns = star.dim_column(star.fact(facts), v, keep_verdict=True)
    verdict = {r.name: r.is_date for r in v.collect()}
    got = {r.name: r.is_date for r in reshape.named_values(star.fact(facts), columns, "verified").collect()}
    assert got == verdict and verdict["77/2031"]
