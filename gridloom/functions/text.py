"""Column expressions on text, numbers and cells (JVM-side only)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The characters Python's str.strip() removes.
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(
    chr(c) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)

# Text that Python's float() accepts; such values are neutral in the vote.
FLOAT_TEXT = (
    r"^[+-]?(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?$"
    r"|^[+-]?(?i:inf|infinity|nan)$"
)


def strip(text: Column) -> Column:
    """Trim Unicode blanks at both ends; Spark's own trim knows only the space."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def is_float_text(text: Column) -> Column:
    return text.rlike(FLOAT_TEXT)


def number_text(num: Column) -> Column:
    """Shortest text of a double in Python's notation: 1000.0, 1e+16, 1.5e-05.

    Spark switches to an exponent at 1e7 and below 1e-3, Python at 1e16 and
    below 1e-4; between the two a decimal of the same digits has none.
    """
    num = num.cast("double")
    java = num.cast("string")
    plain = F.regexp_replace(num.try_cast("decimal(38,20)").cast("string"), r"(\.0|\.\d*?[1-9])0+\z", "$1")
    # The JVM's text of very large doubles can be longer than needed: take the
    # rounding to 16 or 17 digits if it still reads back as the same number.
    short = [F.format_string(f"%.{n}E", num) for n in (15, 16)]
    exact = F.coalesce(*[F.when(t.try_cast("double") == num, t) for t in short], java)
    scientific = F.regexp_replace(F.regexp_replace(exact, r"\.?0*E\+?(\d\d)", "e+$1"), r"\.?0*E-0?(\d)\z", "e-0$1")
    return (
        F.when(~java.rlike("[EIN]"), java)
        .when(F.abs(num).between(F.lit(1e-4), F.lit(9999999999999998.0)), plain)
        .when(java.contains("E"), F.regexp_replace(scientific, r"\.?0*E-", "e-"))
        .otherwise(F.replace(F.lower(java), F.lit("infinity"), F.lit("inf")))
    )


def header_text(cell: Column) -> Column:
    """Header name of a cell: dates as ISO text; blank, 0 and false as ''."""
    falsy = (cell["kind"] == "blank") | (cell["kind"].isin("number", "bool") & (cell["num"] == 0))
    return F.when(falsy, F.lit("")).otherwise(cell_text(cell))


def fingerprint(header: Column) -> Column:
    """Identity of a schema: md5 of the joined header, trimmed and lower-cased."""
    named = F.transform(header, lambda h: F.coalesce(h, F.lit("")))
    return F.md5(F.lower(strip(F.concat_ws("|", named))).cast("binary"))


@F.pandas_udf(T.StringType())
def normalized_name(names: pd.Series) -> pd.Series:
    """Lower-case ASCII name; run it on distinct names only."""
    ascii_only = names.map(
        lambda n: None if n is None else unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode("ascii")
    )
    return ascii_only.str.replace(r"[^A-Za-z0-9_]", "_", regex=True).str.lower()


# ---- cells ---------------------------------------------------------------

CELL = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # blank, text, number, bool, date
        T.StructField("num", T.DoubleType()),
        T.StructField("txt", T.StringType()),  # null where the number says it all
    ]
)


def _cell(kind, num, txt) -> Column:
    return F.struct(
        F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"),
        num.cast("double").alias("num"),
        txt.cast("string").alias("txt"),
    )


def cell_of(value: Column, dtype: T.DataType) -> Column:
    """Cell of a typed column value."""
    none = F.lit(None)
    if isinstance(dtype, T.BooleanType):
        full = _cell("bool", value.cast("int"), F.when(value, "True").otherwise("False"))
    elif isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        full = _cell("number", value, none)
    elif isinstance(dtype, T.NumericType):
        full = _cell("number", value, value)
    elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        full = _cell("date", none, F.date_format(value, "yyyy-MM-dd"))
    elif isinstance(dtype, T.StringType):
        full = _cell("text", none, value)
    else:
        full = _cell("text", none, F.to_json(value))
    return F.when(value.isNull(), _cell("blank", none, F.lit(""))).otherwise(full)


def ingested(cell: Column) -> Column:
    """Cell as stored in the raw rows: dates become text, blanks the empty text."""
    return _cell(
        F.when(cell["kind"] == "date", F.lit("text")).otherwise(cell["kind"]),
        cell["num"],
        F.when(cell["kind"].isin("number", "bool"), cell["txt"]).otherwise(F.coalesce(cell["txt"], F.lit(""))),
    )


def cell_text(cell: Column) -> Column:
    """Text of a cell; the text of a floating number is not stored but rendered."""
    return F.coalesce(cell["txt"], number_text(cell["num"]), F.lit(""))


def has_value(cell: Column) -> Column:
    """True unless the cell is null or exactly ''. A lone space is a value."""
    return F.coalesce(cell["kind"].isin("number", "bool") | ((cell["kind"] != "blank") & (cell["txt"] != "")), F.lit(False))


def quoted_json(text: Column) -> Column:
    """Text as a JSON string literal (non-ASCII kept)."""
    as_array = F.to_json(F.array(text))
    return F.substring(as_array, F.lit(2), F.length(as_array) - F.lit(2))
