"""Column expressions: headers, dates, numbers, names."""

import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F, types as T

from gridloom.functions import dates, text


def apply(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


# Own shapes: every order and separator with days and years drawn by a fixed seed.
_rng = random.Random(11)
ACCEPTED = [
    shape.format(d=_rng.randint(1, 28), m=_rng.randint(1, 12), y=_rng.randint(1900, 2150))
    for shape in ("{d:02d}/{m:02d}/{y}", "{d:02d}-{m:02d}-{y}", "{m:02d}/{y}", "{m:02d}-{y}", "{y}-{m:02d}", "{y}/{m:02d}", "{y}-{m:02d}-{d:02d}", "{y}")
    for _ in range(3)
] + ["88/8888", " 2061\t", "09/11-2061"]
REJECTED = ["Armazem", "Lote 7", "peso_44", "", "07/61", "Guia de Remessa", "09/11/61", "20617", "2061-7", None]


def test_header_test(spark):
    assert apply(spark, ACCEPTED, dates.is_date_header) == [True] * len(ACCEPTED)
    assert apply(spark, REJECTED, dates.is_date_header) == [False] * len(REJECTED)
    assert apply(spark, [" 2025"], lambda c: dates.is_date_header(c, trimmed=False)) == [False]


def test_header_test_with_own_pattern(spark):
    own = r"\d{4}"
    assert apply(spark, ["2025 total", "x2025"], lambda c: dates.is_date_header(c, own)) == [True, False]
    assert apply(spark, ["2025 total", "2025"], lambda c: dates.is_date_header(c, own, whole=True)) == [False, True]


def test_header_date(spark):
    first = date(2025, 1, 1)
    cases = {
        "15/01/2025": date(2025, 1, 15), "15-01-2025": date(2025, 1, 15), "2025-01-15": date(2025, 1, 15), "01/2025": first,
        "2025-01": first, "2025/01": first, "2025": first, "word": None, "": None, "32/13/2025": None, "31/02/2025": None, "0000": None,
        "0000-01": None, "01/0000": None, "29/02/2024": date(2024, 2, 29), " 01/2025 ": first, "15/01-2025": date(2025, 1, 15), "15-01x2025": None,
    }
    assert apply(spark, list(cases), dates.header_date) == list(cases.values())


def test_date_key_and_quarters(spark):
    headers = ["01/2025", "04/2025", "07/2025", "10/2025"]
    assert apply(spark, headers, lambda c: F.quarter(dates.header_date(c))) == [1, 2, 3, 4]
    assert apply(spark, ["15/01/2025"], lambda c: dates.date_key(dates.header_date(c))) == [20250115]


def test_value_vote_dates(spark):
    hits = ["15/01/2025", "15-01-2025", "2025-01-15", "01/2025", "01-2025", "2025-01", " 2025-01 "]
    misses = ["2025/01/15", "15/01-2025", "31/02/2025", "1/1/2025", "N/D", "2025", "0000-01"]
    assert apply(spark, hits, dates.is_date_value) == [True] * len(hits)
    assert apply(spark, misses, dates.is_date_value) == [False] * len(misses)


def test_value_timestamp(spark):
    cases = {
        "15/01/2025": datetime(2025, 1, 15), "1/2/2025": datetime(2025, 2, 1), "2025-1-5": datetime(2025, 1, 5), "2025-01- 5": datetime(2025, 1, 5),
        "3/2025": datetime(2025, 3, 1), "2025-3": datetime(2025, 3, 1), "31/02/2025": None, "15-01-2025": None, "2025": None, "word": None,
        "2025-01-15 10:00:00": None, "  15/01/2025  ": datetime(2025, 1, 15), "0000-01-01": None, "": None, "2025-115": None,
    }
    assert apply(spark, list(cases), dates.value_timestamp) == list(cases.values())


def test_date_label(spark):
    cases = {
        "15/01/2025": "15/01/2025", "15-01-2025": "15/01/2025", "2025-01-15": "15/01/2025", "01/2025": "jan/25", "2024-12": "dez/24",
        "2025": "2025", "15/01": "01/15", "Cliente": "Cliente", "13/2025": "13/2025", "00/2025": "00/2025", "15/01/2025 x": "15/01/2025",
    }
    assert apply(spark, list(cases), dates.date_label) == list(cases.values())


def test_strip_and_float_text(spark):
    samples = ["  a ", " a　", "\x1ca\x1f", "\ta\n", "", " ", "a b"]
    assert apply(spark, samples, text.strip) == [s.strip() for s in samples]
    numbers = ["1", "1.5", "-3", "+.5", "1_000", "1e5", "nan", "Inf", "-infinity", "1d", "1__0", "1 0", "x", "_1", "1.", "."]

    def is_float(s):
        try:
            float(s)
            return True
        except ValueError:
            return False

    assert apply(spark, numbers, text.is_float_text) == [is_float(n) for n in numbers]


def test_number_text_is_the_shortest_python_text(spark):
    rng = random.Random(7)
    values = [0.0, 1.0, -2.5, 1e7, 12345678.91, 1e15, 1e16, 1.5e22, 0.0001, 0.00012345, 1e-5, -3e-7, 1e100, 9999999999999998.0]
    values += [math.nan, math.inf, -math.inf, -0.0] + [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 15) for _ in range(2000)]
    assert apply(spark, values, text.number_text, "double") == [repr(v) for v in values]


def test_header_text(spark):
    row = spark.sql("select 123 i, 0 z, 1.5d d, true t, false f, 'x' s, cast(null as string) n, timestamp_ntz'2025-01-15 10:00:00' ts, date'2025-01-20' dt")
    cells = row.select(*[text.header_text(text.cell_of(F.col(c), row.schema[c].dataType)).alias(c) for c in row.columns]).first()
    assert tuple(cells) == ("123", "", "1.5", "True", "", "x", "", "2025-01-15", "2025-01-20")


def test_fingerprint(spark):
    import hashlib

    headers = [["Cliente", "", "01/2025"], ["  A", "b  "], [""], ["a|b"]]
    expect = [hashlib.md5("|".join(h).strip().lower().encode()).hexdigest() for h in headers]
    assert apply(spark, headers, text.fingerprint, "array<string>") == expect


def test_normalized_name(spark):
    import re
    import unicodedata

    names = ["Região Nº", "Preço (R$)", "01/2025", "ß²", "Ação_1", ""]
    expect = [re.sub("[^a-zA-Z0-9_]", "_", unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode()).lower() for n in names]
    assert apply(spark, names, text.normalized_name) == expect


@pytest.mark.parametrize("value", ['a"b', "é\n", "\\", "", "tab\t"])
def test_quoted_json(spark, value):
    import json

    assert json.loads(apply(spark, [value], text.quoted_json)[0]) == value


def test_has_value(spark):
    def cell(kind, num, txt):
        return F.struct(F.lit(kind).alias("kind"), F.lit(num).cast("double").alias("num"), F.lit(txt).cast("string").alias("txt"))

    row = spark.range(1).select(
        text.has_value(cell("text", None, "")), text.has_value(cell("text", None, " ")), text.has_value(cell("blank", None, "")),
        text.has_value(cell("number", 0.0, None)), text.has_value(F.lit(None).cast(T.StructType(text.CELL.fields))),
    ).first()
    assert tuple(row) == (False, True, False, True, False)
