"""Run a registered query and its SQL, and compare the two results row by row."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


def differences(df, con, sql) -> str:
    """Empty when both agree in names, values and Python types."""
    a_names, a = rows_of_spark(df)
    b_names, b = rows_of_sql(con, sql)
    if a_names != b_names:
        return f"columns {a_names} <> {b_names}"
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return f"{len(a)} <> {len(b)} rows; only Spark {only_a}; only SQL {only_b}"
    types = lambda rows: [{type(r[i]).__name__ for r in rows if r[i] is not None} for i in range(len(a_names))]
    return "" if types(a) == types(b) else f"types {types(a)} <> {types(b)}"
