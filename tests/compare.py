"""Run a query in Spark and its SQL in an independent engine and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def spark_rows(df) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    return columns, Counter(tuple(plain(v) for v in row) for row in rows)


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())


def types_of(con: duckdb.DuckDBPyConnection, sql: str) -> dict[str, str]:
    cursor = con.execute(sql)
    return {d[0]: str(d[1]) for d in cursor.description}


def difference(df, con, sql: str) -> str | None:
    """What differs, or None."""
    columns, mine = spark_rows(df)
    names, theirs = duck_rows(con, sql)
    if columns != names:
        return f"columns {columns} against {names}"
    if mine != theirs:
        a, b = list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
        return f"{sum(mine.values())} rows against {sum(theirs.values())}; only here {a}; only there {b}"
    return None
