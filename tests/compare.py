"""Runs a query and its SQL side by side and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

ROOT = "/root/testdata"


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.astimezone(datetime.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def oracle_rows(folder: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    return columns, Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
