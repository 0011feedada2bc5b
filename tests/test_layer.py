"""Stored layers: whole files are replaced, jobs that die leave the layer as it was, compaction keeps what counts."""

import pytest
from pyspark.sql import functions as F

from gridloom.sources.layer import Layer

SCHEMA = "file_id bigint, sheet string, line_no bigint, schema_hash string"


@pytest.fixture
def layer(spark, tmp_path):
    return Layer(spark, str(tmp_path / "layer"), SCHEMA)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def listed(spark, *values):
    return spark.createDataFrame(list(values), "file_id bigint, sheet string")


def state(layer):
    return sorted(map(tuple, layer.read().select("file_id", "sheet", "line_no", "schema_hash").collect()), key=repr)


def test_before_any_load(layer):
    assert (layer.version(), state(layer), layer.ledger().count()) == (0, [], 0)


def test_changed_file(spark, layer):
    layer.load(rows(spark, (1, "a", 2, "h1"), (1, "a", 3, "h1"), (1, "b", 2, "h1"), (2, "a", 2, "h1")), listed(spark, (1, "a"), (1, "b"), (2, "a")))
    # Another header, a line less, one sheet emptied, one gone; the other file is not loaded.
    layer.load(rows(spark, (1, "a", 2, "h2")), listed(spark, (1, "a"), (1, "c")))
    assert state(layer) == [(1, "a", 2, "h2"), (2, "a", 2, "h1")]
    assert {(r.file_id, r.sheet, r.load): (r.n_rows, r.is_current) for r in layer.ledger().collect()} == {
        (1, "a", 1): (2, False), (1, "b", 1): (1, False), (2, "a", 1): (1, True), (1, "a", 2): (1, True), (1, "c", 2): (0, True)
    }
    assert layer.read(history=True).groupBy("load").count().orderBy("load").collect() == [(1, 4), (2, 1)]
    # A file without any sheet, and a load without any row.
    layer.load(rows(spark), listed(spark, (2, None)))
    assert state(layer) == [(1, "a", 2, "h2")]


def test_sheets_supersede_themselves_without_a_list(spark, layer):
    layer.load(rows(spark, (1, "a", 2, "h1"), (1, "b", 2, "h1")))
    layer.load(rows(spark, (1, "a", 5, "h2")))
    assert state(layer) == [(1, "a", 5, "h2"), (1, "b", 2, "h1")]
    layer.load(rows(spark, (1, "a", 6, None)), replace=False)
    assert state(layer) == [(1, "a", 5, "h2"), (1, "a", 6, None), (1, "b", 2, "h1")]


def test_a_job_that_dies_changes_nothing(spark, layer, monkeypatch):
    layer.load(rows(spark, (1, "a", 2, "h1")))
    with monkeypatch.context() as m:
        m.setattr(Layer, "_commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            layer.load(rows(spark, (1, "a", 3, "h1"), (9, "x", 9, "h9")))
    assert (layer.version(), state(layer)) == (1, [(1, "a", 2, "h1")])
    layer.load(rows(spark, (1, "a", 4, "h1")))
    assert (layer.version(), state(layer)) == (2, [(1, "a", 4, "h1")])


def test_a_second_writer_is_refused(spark, layer):
    layer.load(rows(spark, (1, "a", 2, "h1")))
    with pytest.raises(RuntimeError, match="somebody else"):
        layer._commit(layer.ledger(), 1)


def test_rows_may_come_from_the_layer_itself(spark, layer):
    layer.load(rows(spark, (1, "a", 2, "h1"), (1, "a", 3, "h1")))
    layer.load(layer.read().filter("line_no = 3"))
    assert state(layer) == [(1, "a", 3, "h1")]


def test_compaction(spark, layer, tmp_path):
    layer.load(rows(spark, (1, "a", 2, "h1"), (2, "a", 2, "h1")), listed(spark, (1, "a"), (2, "a")))
    layer.load(rows(spark), listed(spark, (1, "a")))
    layer.load(rows(spark, (2, "a", 7, "h1")), replace=False)
    before = state(layer)
    assert layer.compact() == 4 and state(layer) == before == [(2, "a", 2, "h1"), (2, "a", 7, "h1")]
    assert sorted(p.name for p in (tmp_path / "layer/rows").iterdir()) == ["load=4"]
    assert sorted(map(tuple, layer.ledger().collect())) == [(1, "a", 4, 0, True), (2, "a", 4, 2, True)]
    layer.load(rows(spark, (2, "a", 8, "h1")))
    assert state(layer) == [(2, "a", 8, "h1")]


def test_buckets_are_few(spark, layer, tmp_path):
    layer.load(spark.range(3000).select(F.col("id").alias("file_id"), F.lit("s").alias("sheet"), F.lit(2).cast("bigint").alias("line_no"), F.md5(F.col("id").cast("string").cast("binary")).alias("schema_hash")))
    assert len([p for p in (tmp_path / "layer/rows/load=1").iterdir() if p.name.startswith("bucket=")]) == 256
    assert layer.read().filter(F.col("schema_hash") == F.md5(F.lit("7").cast("binary"))).count() == 1
