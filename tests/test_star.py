"""Detection, unpivot, star, read-back, cleanup and catalog on small literal sheets."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import catalog, cleanup, detect, grid, layers, reshape, skew, star, unpivot
from gridloom.sources import sinks
from test_grid import GRID, make


def sheet(*rows):
    header = list(dict.fromkeys(k for r in rows for k in r))
    return [header, *[[r.get(h) for h in header] for r in rows]]


def load(spark, sheets, **options):
    g = make(spark, sheets)
    t = grid.tables(g, grid.table_extents(g, detect=False))
    raw = grid.raw_rows(g, t)
    v = detect.verdict(raw, detect.schemas(t), **options)
    return raw, t, v, unpivot.unpivot_rows(raw, detect.layout(v), t)


def shop(*dates, n=1, **fixed):
    """n rows with the fixed columns and a made-up amount for every date."""
    return [{**{k: f"{v}{i}" for k, v in fixed.items()}, **{d: 7 * i + j + 0.25 for j, d in enumerate(dates)}} for i in range(n)]


FIXTURES = [
    (shop("05/2031", "06/2031", n=2, Loja="l", Zona="z"), 8, 2),
    (shop("03/09/2031", "21/09/2031", Loja="l"), 3, 2),
    (shop("05/2031", "06/2031"), 2, 2),
    (shop("05/2031", n=2, Loja="l"), 4, 1),
    (shop("2031-09-03", "2031-09-04", n=2, Zona="z") + [{"Zona": "Zona", "2031-09-03": "2031-09-03", "2031-09-04": "2031-09-04"}] + shop("2031-09-03", "2031-09-04", n=2, Zona="y"), 15, 2),
]


@pytest.mark.parametrize("rows, n_facts, n_dates", FIXTURES)
def test_unpivot_fixtures(spark, rows, n_facts, n_dates):
    _, _, v, facts = load(spark, {(1, "Sheet1"): sheet(*rows)})
    assert facts.count() == n_facts
    assert star.dim_date(v.filter("is_date")).count() == n_dates
    assert facts.filter("value_num is not null and date_key is null and is_date").count() == 0


VOTES = [
    ("03/09/2031", [11, 12], 0.7, True),
    ("2031", ["Q-7", "R-8"], 0.7, False),
    ("05/2031", ["03/09/2031", "sem dado", "21/09/2031"], 0.5, True),
    ("05/2031", ["03/09/2031", "sem dado", "21/09/2031"], 0.7, False),
    ("05/2031", [41], 0.7, True),
    ("05/2031", [41, 42, 43, 44, "sem dado"], 0.7, True),
    ("Armazem", ["um", "dois", "tres", "quatro", "cinco"], 0.7, False),
    ("2031-09-03", [5, 6, 7, "2031-09-03", "2031-09-04"], 0.7, True),
    ("2025", [None, " ", ""], 0.7, False),
    ("2025", ["1_000", "nan", "1d"], 0.7, False),
    ("2025", ["x", "x", "x", 1, 2, 3], 0.7, True),  # repeated values count once
    ("2025", ["x", "y", 1, 2, 3], 0.7, False),
]


@pytest.mark.parametrize("header, values, threshold, expect", VOTES)
def test_value_vote(spark, header, values, threshold, expect):
    rows = [["Id", header]] + [["k", v] for v in values]
    _, _, v, _ = load(spark, {(1, "s"): rows}, threshold=threshold)
    assert v.filter(F.col("name") == header).first().is_date is expect


def test_sample_is_the_first_rows_of_all_tables_of_a_schema(spark):
    sheets = {(f, "s"): [["K", "2025"]] + [["k", None if i < 3 else f"v{f}{i}"] for i in range(6)] for f in (1, 2, 3)}
    for rows, expect in ((9, 0), (10, 1), (18, 5)):
        _, _, v, _ = load(spark, sheets, sample_rows=rows)
        r = v.filter("name = '2025'").first()
        assert r.misses == expect


def test_equal_headers_in_other_case_share_a_schema_by_position(spark):
    raw, t, v, facts = load(spark, {(1, "a"): [["Nome", "2025"], ["x", 1]], (2, "b"): [["NOME", "2025"], ["y", 2]]})
    assert t.select("schema_hash").distinct().count() == 1
    assert sorted((r.name, r.value_text) for r in facts.filter("value_text is not null").collect()) == [("Nome", "x"), ("Nome", "y")]


def test_typed_values_and_dimensions(spark):
    body = [["Código", "Obs", "Obs", "01/2025", "99/9999"], ["texto", " ", "", 42.5, 7], [3, "15/01/2025", "last", "N/D", 8], [4, None, "z", 1, 9], [5, None, "w", 2, 10]]
    raw, t, v, facts = load(spark, {(5, "s"): body})
    got = {(r.line_no, r.name): (r.value_text, r.value_num, str(r.value_date) if r.value_date else None, r.date_key) for r in facts.collect()}
    assert got[(2, "Código")] == ("texto", None, None, None) and got[(2, "01/2025")] == (None, 42.5, None, 20250101)
    assert got[(2, "99/9999")] == (None, 7.0, None, None)  # an impossible date keeps its fact
    assert (2, "Obs") not in got and got[(3, "Obs")][0] == "last"
    cols = {r.original_name: (r.normalized_name, r.dtype) for r in star.dim_column(star.fact(facts), v).collect()}
    assert cols == {"Código": ("codigo", "text"), "Obs": ("obs", "text"), "01/2025": ("01_2025", "number"), "99/9999": ("99_9999", "number")}
    files = star.dim_file(raw, spark.createDataFrame([(1, "a.xlsx")], "file_id bigint, name string")).first()
    assert tuple(files) == (5, "desconhecido", "db://5")
    d = star.dim_date(v.filter("is_date")).first()
    assert (d.date_key, d.quarter, d.month_name, d.weekday) == (20250101, 1, "January", 2)


def test_inverted_mode(spark):
    g = make(spark, {(1, "s"): [["Cliente", "Regiao", "01/2025", "2024"], ["Joao", "Sul", 5, "x"]]})
    t = grid.tables(g, grid.table_extents(g, detect=False))
    facts = unpivot.unpivot_inverted(grid.raw_rows(g, t), t, "Cliente").collect()
    assert {(r.name, r.date_key, r.value_num, r.value_text) for r in facts} == {("Cliente", 20250101, 5.0, None), ("Cliente", 20240101, None, "x")}
    dim = star.dim_column_inverted(unpivot.inverted_layout(t, "Cliente"), "Cliente").collect()
    assert [(r.original_name, r.dtype) for r in dim] == [("Cliente", "text")] and dim[0].column_key == facts[0].column_key


def test_wide_unpivot_prunes_headers_in_the_plan(spark):
    from datetime import date

    df = spark.createDataFrame([("a", 1.0, 2.0, None), ("b", None, 4.0, 5.0)], "k string, `01/2025` double, `2025-02` double, `15/03/2025` double")
    out = unpivot.unpivot_dates(df)
    assert sorted((r.k, r.header, r.date, r.value) for r in out.collect()) == [
        ("a", "01/2025", date(2025, 1, 1), 1.0), ("a", "2025-02", date(2025, 2, 1), 2.0),
        ("b", "15/03/2025", date(2025, 3, 15), 5.0), ("b", "2025-02", date(2025, 2, 1), 4.0),
    ]
    some = unpivot.unpivot_dates(df, start=date(2025, 2, 1), end=date(2025, 2, 28))
    assert {r.header for r in some.collect()} == {"2025-02"}
    expand = some._jdf.queryExecution().optimizedPlan().toString().split("Expand")[1].split("\n")[0]
    assert "2025-02" in expand and "15/03/2025" not in expand


def test_load_twice_changes_nothing(spark, tmp_path):
    _, _, _, facts = load(spark, {(1, "s"): [["C", "01/2025"], ["x", 1], ["y", 2]], (2, "t"): [["D", "2024"], ["z", 3]]})
    for _ in range(2):
        sinks.replace_facts(star.fact(facts), str(tmp_path / "fact"))
    stored = sinks.read_facts(spark, str(tmp_path / "fact"))
    assert stored.count() == 6 and sorted(stored.columns) == sorted(star.FACT)
    one = star.fact(facts).filter("sheet = 't'").withColumn("value_num", F.col("value_num") * 10)
    sinks.replace_facts(one, str(tmp_path / "fact"))
    assert sinks.read_facts(spark, str(tmp_path / "fact")).agg(F.sum("value_num")).first()[0] == 33.0


def test_raw_append_and_read(spark, tmp_path):
    raw, *_ = load(spark, {(1, "s"): [["C", "01/2025"], ["x", 1]]})
    sinks.append_raw(raw, str(tmp_path / "raw"))
    sinks.append_raw(raw, str(tmp_path / "raw"))
    back = sinks.read_raw(spark, str(tmp_path / "raw"))
    assert back.count() == 2 and back.select("schema_hash").distinct().count() == 1
    h = raw.first().schema_hash
    assert layers.raw_of_schema(back, h).count() == 2 and layers.raw_of_schema(back, h[:5]).count() == 2
    assert layers.raw_of_schema(back, "zz").count() == 0 and layers.raw_of_table(back, 1, "s", 1).count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_unpivot_then_read_back_is_the_table(spark, seed):
    """Random sheets: every non-blank date cell comes back once with its line's entities."""
    rng = random.Random(seed)
    months = rng.sample([f"{m:02d}/{y}" for y in (2023, 2024) for m in range(1, 13)], 6)
    rows = [{"Cliente": f"c{i}", "Zona": rng.choice(["N", "S", None]), **{m: rng.choice([None, i + 0.5, 10]) for m in months}} for i in range(20)]
    rows[0] = {**rows[0], **{m: 1 for m in months}}
    _, _, v, facts = load(spark, {(1, "s"): sheet(*rows)})
    values = reshape.named_values(star.fact(facts), star.dim_column(star.fact(facts), v))
    got = sorted((r.line_no, r.entity["Cliente"], r.entity.get("Zona"), r.label, r.value) for r in reshape.corrected(values).collect())
    names = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]
    label = lambda m: f"{names[int(m[:2]) - 1]}/{m[5:]}"
    expect = sorted((i, r["Cliente"], r["Zona"], label(m), str(float(r[m]))) for i, r in enumerate(rows, 2) for m in months if r[m] is not None)
    assert got == expect


def test_last_load_wins_and_normal_sheets_pass(spark):
    _, _, v, facts = load(spark, {(1, "inv"): [["C", "01/2025"], ["x", 1], ["no value", None]], (1, "norm"): [["A", "B"], ["p", 1], ["q", None]]})
    f = star.fact(facts)
    again = f.filter("value_num = 1 and sheet = 'inv'").withColumn("load_no", F.lit(1).cast("bigint")).withColumn("value_num", F.lit(9.0))
    values = reshape.named_values(f.unionByName(again), star.dim_column(f, v))
    got = sorted((r.sheet, r.line_no, tuple(sorted(r.entity.items())), r.label, r.value) for r in reshape.corrected(values).collect())
    assert got == [("inv", 2, (("C", "x"),), "jan/25", "9.0"), ("norm", 2, (("A", "p"), ("B", "1.0")), None, None), ("norm", 3, (("A", "q"),), None, None)]
    cols = {r.sheet: (r.columns, r.inverted) for r in reshape.sheet_columns(values).collect()}
    assert cols == {"inv": (["C"], True), "norm": (["A", "B"], False)}


def test_side_by_side(spark):
    def sub(k, n):
        return [["Reg", "01/2025", "02/2025"]] + [[f"{k}{i}", i, i * 2] for i in range(n)]

    _, _, v, facts = load(spark, {(1, "R__T001"): sub("a", 2), (1, "R__T002"): sub("b", 1)})
    f = star.fact(facts)
    out = reshape.side_by_side(reshape.aligned(reshape.named_values(f, star.dim_column(f, v))), {1: ["Reg"], 2: ["Reg"]}, "Data", "Valor")
    rows = sorted((r.position, r.t1_Reg, r.t1_Data, r.t1_Valor, r.t2_Reg, r.t2_Valor) for r in out.collect())
    assert rows == [
        (1, "a0", "jan/25", "0.0", "b0", "0.0"), (2, "a0", "fev/25", "0.0", "b0", "0.0"),
        (3, "a1", "jan/25", "1.0", "", ""), (4, "a1", "fev/25", "2.0", "", ""),
    ]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_sheets_are_written_one_folder_each(spark, tmp_path, fmt):
    _, _, v, facts = load(spark, {(1, "inv"): [["C", "01/2025"], ['a;"b"', 1]], (2, "inv"): [["C", "01/2025"], ["y", 2]], (1, "norm"): [["A", "a"], ["p", 1]]})
    f = star.fact(facts)
    values = reshape.named_values(f, star.dim_column(f, v))
    folders = sinks.write_sheets(reshape.corrected(values), reshape.sheet_columns(values), str(tmp_path), fmt)
    assert len(folders) == 2
    reader = spark.read.option("sep", ";").option("header", "true").option("escape", '"')
    tables = [(reader.csv(p) if fmt == "csv" else spark.read.parquet(p)) for p in folders]
    got = {tuple(t.columns): sorted(tuple(map(str, r)) for r in t.collect()) for t in tables}
    assert got == {
        ("A", "a_2", "file_id", "sheet"): [("p", "1.0", "1", "norm")],
        ("C", "Data", "Valor", "file_id", "sheet"): [('a;"b"', "jan/25", "1.0", "1", "inv"), ("y", "jan/25", "2.0", "2", "inv")],
    }


def test_export_set_and_raw_only(spark):
    raw, t, v, facts = load(spark, {(1, "inv"): [["C", "01/2025"], ["x", 1]], (1, "other"): [["A"], ["p"], [None]]})
    f = star.fact(facts).filter("sheet = 'inv'")
    values = reshape.named_values(f, star.dim_column(f, v))
    originals = reshape.raw_tables(raw, t)
    only = reshape.raw_only(originals, f)
    out = reshape.export_set(reshape.corrected(values), originals, only).collect()
    assert sorted((r.origin, r.sheet, r.line_no, r.entity.get("A")) for r in out) == [("fact", "inv", 2, None), ("raw", "other", 2, "p"), ("raw", "other", 3, "")]


def test_cleanup(spark):
    raw, _, _, facts = load(spark, {(1, "s"): [["C", "01/2025"], ["x", 1]], (2, "u"): [["Z"], ["q"]]})
    f = star.fact(facts).filter("sheet = 's'")
    copies = f.unionByName(f.withColumn("load_no", F.lit(2).cast("bigint")).withColumn("value_num", F.lit(5.0)))
    assert cleanup.duplicate_groups(copies).count() == 2  # one of them without a date
    kept = cleanup.dedupe(copies).collect()
    assert len(kept) == 2 and {r.load_no for r in kept} == {0}
    assert cleanup.purge(raw, f).count() == 1 and cleanup.purge(raw, f, keep_raw=True).count() == 2
    audit = spark.createDataFrame([(1, "s", i) for i in range(60)] + [(2, "u", i) for i in range(3)], "file_id bigint, table_name string, at int")
    left = cleanup.retain(audit, [F.desc("at")], 50)
    assert left.count() == 53 and left.filter("file_id = 1").agg(F.min("at")).first()[0] == 10
    assert tuple(cleanup.diagnostic(raw, audit, copies).first()) == (1, 63, 2)
    assert tuple(cleanup.stats(raw, audit, copies).first()) == (1, 10, 2)
    assert tuple(cleanup.stats(raw, audit, copies, keep_raw=True).first()) == (0, 10, 2)


def test_dedupe_by_hashes_and_whole(spark):
    """Equal results with and without the hashes of repeated keys; nulls in a key are equal; only rows that may repeat are shuffled."""
    schema = "file_id bigint, date_key int, column_key string, schema_hash string, sheet string, line_no bigint, load_no bigint, value_num double, value_text string, value_date date"
    once = [(1, 20250100 + i % 28, "k", "h", "s", i, 0, float(i), None, None) for i in range(300)]
    again = [(1, 20250100 + i % 28, "k", "h", "s", i, 1, -1.0, None, None) for i in range(0, 300, 10)]
    nulls = [(None, None, None, None, None, None, n, None, str(n), None) for n in (3, 2, None, 2)]
    f = spark.createDataFrame(once + again + nulls, schema)
    sent, whole = cleanup.dedupe(f), cleanup.dedupe(f, sent=0)
    assert sorted(map(str, sent.collect())) == sorted(map(str, whole.collect()))
    assert sent.count() == 301 and sent.filter("value_num < 0").count() == 0 and sent.columns == f.columns
    assert cleanup.dedupe(f.limit(0)).count() == 0
    plan = sent._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_cleaning_in_one_run_counts_what_it_removed(spark, tmp_path):
    raw, _, _, facts = load(spark, {(1, "s"): [["C", "01/2025"], ["x", 1]], (2, "u"): [["Z"], ["q"]]})
    f = star.fact(facts).filter("sheet = 's'")
    copies = f.unionByName(f.withColumn("load_no", F.lit(2).cast("bigint")))
    audit = spark.createDataFrame([(1, "s", i) for i in range(60)], "file_id bigint, table_name string, at int")
    for keep_raw in (False, True):
        told = cleanup.clean(raw, audit, copies, str(tmp_path / str(keep_raw)), [F.desc("at")], keep_raw)
        assert tuple(told.first()) == tuple(cleanup.stats(raw, audit, copies, keep_raw).first()) == (0 if keep_raw else 1, 10, 2)
        assert [spark.read.parquet(str(tmp_path / str(keep_raw) / n)).count() for n in ("raw", "audit", "fact")] == [2 if keep_raw else 1, 50, 2]
    assert tuple(cleanup.clean(raw.limit(0), audit.limit(0), copies.limit(0), str(tmp_path / "none"), [F.desc("at")]).first()) == (0, 0, 0)


def test_manifest_life_cycle(spark):
    cols = "name string, path string, mtime timestamp, size bigint"
    t1, t2 = "2025-01-01 00:00:00", "2025-01-02 00:00:00"

    def listing(*rows):
        return spark.createDataFrame([(p, p, t, s) for p, t, s in rows], "name string, path string, mtime string, size bigint").withColumn(
            "mtime", F.col("mtime").cast("timestamp")
        )

    empty = spark.createDataFrame([], "file_id bigint, " + cols + ", status string")
    first = catalog.refresh(empty, listing(("a", t1, 1), ("b", t1, 1), ("c", None, 1)))
    ids = {r.path: r.file_id for r in first.collect()}
    assert len(set(ids.values())) == 3 and {r.status for r in first.collect()} == {"pending"}
    done = catalog.set_status(first, first.filter("path <> 'b'").select("file_id", F.lit("ingested").alias("status")))
    second = catalog.refresh(done, listing(("a", t1, 5), ("c", t2, 1), ("d", t1, 1)))
    got = {r.path: (r.file_id, r.size, r.status) for r in second.collect()}
    assert got["a"] == (ids["a"], 5, "ingested") and got["c"][2] == "pending" and got["b"] == (ids["b"], 1, "pending")
    assert got["d"][0] not in ids.values() and got["d"][2] == "pending"
    assert catalog.with_status(second).count() == 3


def test_catalog_and_audit(spark):
    entry = "file_id bigint, table_name string, schema_hash string, header array<string>"
    old = spark.createDataFrame([(1, "a", "h1", ["x", "y"]), (1, "b", "h1", ["x"]), (2, "c", None, ["q"])], entry)
    new = spark.createDataFrame([(1, "a", "h2", ["y", "z"]), (1, "b", "h1", ["x"]), (2, "c", "h9", ["q"]), (3, "d", "h3", ["n"])], entry)
    audit = catalog.changes(old, new).collect()
    assert [(r.table_name, r.old_hash, r.new_hash, r.added, r.removed) for r in audit] == [("a", "h1", "h2", ["z"], ["x"])]
    merged = {(r.file_id, r.table_name): r.schema_hash for r in catalog.upsert_tables(old, new).collect()}
    assert merged == {(1, "a"): "h2", (1, "b"): "h1", (2, "c"): "h9", (3, "d"): "h3"}
    versions = old.withColumn("v", F.lit(1)).unionByName(new.withColumn("v", F.lit(2)))
    history = catalog.history_changes(versions, "v").collect()
    assert [(r.table_name, r.v, r.added) for r in history] == [("a", 2, ["z"])]


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_spread_join_is_a_plain_join(spark, hot_rows):
    rows = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 50}", i) for i in range(600)], "k string, i int")
    info = rows.select("k").distinct().withColumn("x", F.length("k"))
    out = skew.join_spread(rows, info, rows.groupBy("k").agg(F.count("*").alias("n")), "k", ["i"], hot_rows)
    assert sorted(map(tuple, out.select("k", "i", "x").collect())) == sorted((r.k, r.i, len(r.k)) for r in rows.collect())


def test_warning_for_schemas_without_fixed_columns(spark):
    _, _, v, _ = load(spark, {(1, "s"): [["01/2025", "02/2025"], [1, 2]], (2, "t"): [["C", "02/2025"], ["x", 2]]})
    assert [r.n_columns for r in detect.without_fixed_columns(v).collect()] == [2]
    assert sorted(r.name for r in detect.fixed_columns(v).collect()) == ["C"]
