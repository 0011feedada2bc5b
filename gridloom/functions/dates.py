"""Column expressions on date headers and date values.

Spark 4 runs in ANSI mode, so every parse is a ``try_`` function behind a
shape test: nothing raises, and no exception is paid for ordinary text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridloom.functions.text import strip

# The default header pattern, and the Portuguese month names.
DATE_HEADER = r"^(?:\d{2}[/-]\d{2}[/-]\d{4}|\d{2}[/-]\d{4}|\d{4}[/-]\d{2}(?:[/-]\d{2})?|\d{4})$"
MONTH_LABELS = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]


def is_date_header(name: Column, pattern: str = DATE_HEADER, whole: bool = False, trimmed: bool = True) -> Column:
    """Does a header look like a date? Digit shape only: 99/9999 passes.

    ``pattern`` is anchored at the start, and also at the end with ``whole``.
    """
    text = strip(name) if trimmed else name
    return F.coalesce(text.rlike(f"\\A(?:{pattern})" + ("\\z" if whole else "")), F.lit(False))


def _rewritten(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _parsed(iso: Column, part: str) -> Column:
    """Date of an ISO-shaped text, null for anything else and for the year 0000."""
    return F.when(iso.rlike(rf"\A(?!0000)\d{{4}}-{part}-{part}\z"), F.try_to_date(iso, "yyyy-M-d"))


def _iso(text: Column, dash_only: bool) -> Column:
    """ISO text of dd-mm-yyyy, mm-yyyy, yyyy-mm and yyyy by position; other text as it is."""
    at = lambda start, n: F.substring(text, start, n)
    size, third = F.length(text), at(3, 1)
    parted = third == "-" if dash_only else third.isin("-", "/")
    return (
        F.when((size == 10) & parted & (at(6, 1) == third), F.concat(at(7, 4), F.lit("-"), at(4, 2), F.lit("-"), at(1, 2)))
        .when((size == 7) & parted, F.concat(at(4, 4), F.lit("-"), at(1, 2), F.lit("-01")))
        .when(size == 7, F.concat(text, F.lit("-01")))
        .otherwise(F.when(size == 4, F.concat(text, F.lit("-01-01"))).otherwise(text) if dash_only else text)
    )


def header_date(name: Column) -> Column:
    """Date of a header; months and years give their first day, the impossible null."""
    return _parsed(_iso(F.translate(strip(name), "/", "-"), dash_only=True), r"\d{2}")


def date_key(date: Column) -> Column:
    """Dimension key of a date, as the number yyyymmdd."""
    return F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)


def is_date_value(text: Column) -> Column:
    """Strict date test of the value vote (two-digit days and months, one separator)."""
    return _parsed(_iso(strip(text), dash_only=False), r"\d{2}").isNotNull()


def value_timestamp(text: Column) -> Column:
    """Timestamp of a text value, or null: d/m/Y, Y-m-d, m/Y, Y-m with 1-2 digit parts."""
    value = F.substring(strip(text), 1, 19)
    iso = _rewritten(
        value,
        (r"\A(\d{1,2})/(\d{1,2})/(\d{4})\z", "$3-$2-$1"),
        (r"\A(\d{1,2})/(\d{4})\z", "$2-$1"),
        (r"\A(\d{4}-\d{1,2})\z", "$1-1"),
        (r"\A(\d{4}-\d{1,2}-) ([1-9])\z", "$1$2"),
    )
    # Ordinary text is turned away by one test.
    return F.when(value.rlike(r"\A\d{1,4}[/-]"), _parsed(iso, r"\d{1,2}")).cast("timestamp_ntz")


def date_label(name: Column) -> Column:
    """Readable label: full dates as dd/mm/yyyy, months as mmm/yy, dd/mm as mm/dd."""
    full = _rewritten(
        name,
        (r"(?s)\A(\d{2})[/-](\d{2})[/-](\d{4}).*\z", "$1/$2/$3"),
        (r"(?s)\A(\d{4})[/-](\d{2})[/-](\d{2}).*\z", "$3/$2/$1"),
        (r"\A(\d{2})[/-](\d{2})\z", "$2/$1"),
    )
    month = F.regexp_replace(name, r"\A(\d{4})[/-](\d{2})\z", "$2/$1")
    number = F.substring(month, 1, 2).try_cast("int")
    label = F.substring(F.lit("".join(MONTH_LABELS)), number * 3 - 2, F.lit(3))
    return F.when(
        month.rlike(r"\A(?:0[1-9]|1[0-2])[/-]\d{4}\z"), F.concat(label, F.lit("/"), F.substring(month, 6, 2))
    ).otherwise(full)
