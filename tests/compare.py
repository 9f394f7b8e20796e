"""Run registered queries against their DuckDB twins."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return int(value) if value == int(value) and abs(value) < 1e15 else value
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if equal, else what differs first."""
    spark_names = df.columns
    spark_rows = _rows(spark_names, [tuple(r) for r in df.collect()])
    con.execute(sql)
    sql_names = [d[0] for d in con.description]
    sql_rows = _rows(sql_names, con.fetchall())
    if sorted(spark_names) != sorted(sql_names):
        return f"columns {sorted(set(spark_names) ^ set(sql_names))}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    names = sorted(spark_names)
    for a, b in zip(spark_rows, sql_rows):
        if a != b:
            return str([(n, x, y) for n, x, y in zip(names, a, b) if x != y][:4])
    return None
