"""Compare a Spark result with DuckDB's, without regard to row order."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb

# The sample tables.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _sortable(row: tuple):
    return [(value is None, str(type(value)), value if value is not None else 0) for value in row]


def normalised(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=_sortable)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), normalised(df.columns, df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    return sorted(columns), normalised(columns, cursor.fetchall())
