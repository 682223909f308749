"""Run a query in Spark and its SQL in DuckDB and compare the rows as a multiset."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else a short account of what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    expected = found.fetchall()
    got = [tuple(r) for r in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns: spark {sorted(spark_df.columns)} sql {sorted(names)}"
    left, right = rows_of(spark_df.columns, got), rows_of(names, expected)
    if len(left) != len(right):
        return f"rows: spark {len(left)} sql {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference:\n  spark {a}\n  sql   {b}"
    return None if left else "both sides are empty"
