"""Runs a query in Spark and its SQL in DuckDB and compares schema and rows."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(v) -> object:
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return v.item() if hasattr(v, "item") else v


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(_kind(row[k]) for k in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


SAME = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
        "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when equal, else what differs."""
    rel = con.sql(sql)
    want_cols, want = rows_of(rel.columns, rel.fetchall())
    got_cols, got = rows_of(df.columns, df.collect())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    types = {c: (t, theirs[c]) for c, t in df.dtypes if SAME.get(t) != theirs[c]}
    if types:
        return f"types {types}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{len(got)} rows; first difference\n  got  {g}\n  want {w}"
    return ""
