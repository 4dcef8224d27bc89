"""Comparison of a Spark result with DuckDB on the same tables, whatever the order of rows."""

from pathlib import Path

import duckdb


def tables(folder):
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return f"{value:.5f}"
    return str(value)


def rows(frame, columns):
    return sorted(tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False))
