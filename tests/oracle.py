"""Compare a Spark result with the result of its check query, value by value."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, Decimal)):
        return "float"
    return type(value).__name__


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    return value


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both hold the same rows, else a short account of the first difference."""
    columns = sorted(df.columns)
    ours = [tuple(_plain(row[c]) for c in columns) for row in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = [tuple(_plain(row[i]) for i in order) for row in cursor.fetchall()]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)} rows; ours {sorted(ours, key=repr)[:2]} theirs {sorted(theirs, key=repr)[:2]}"
    ours.sort(key=repr)
    theirs.sort(key=repr)
    for a, b in zip(ours, theirs):
        if a != b or [_kind(x) for x in a] != [_kind(x) for x in b]:
            return f"{columns}\n  ours   {a}\n  theirs {b}"
    return None
