"""Run catalog queries beside their SQL text in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def comparable(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, connection, name, entry, folder) -> tuple[bool, int, str]:
    frame = entry.query(spark, folder)
    got = comparable(frame.columns, [tuple(r) for r in frame.collect()])
    if entry.sql is None:
        return True, len(got), "rows only"
    cursor = connection.execute(entry.sql)
    columns = [d[0] for d in cursor.description]
    want = comparable(columns, cursor.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return False, len(got), f"columns {frame.columns} != {columns}"
    if got != want:
        differing = [pair for pair in zip(got, want) if pair[0] != pair[1]][:2]
        return False, len(got), f"{len(got)} vs {len(want)} rows; {differing}"
    return True, len(got), ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from tillwright.catalog import ENTRIES
    from tillwright.session import build_session

    folder = sys.argv[1]
    prefixes = sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g")
    connection = connect(folder)
    failed = 0
    for name, entry in ENTRIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        started = time.time()
        try:
            good, rows, note = compare(spark, connection, name, entry, folder)
        except Exception as error:  # noqa: BLE001
            good, rows, note = False, -1, f"{type(error).__name__}: {str(error)[:900]}"
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name:38s} {rows:7d} rows {time.time() - started:6.2f}s {note}", flush=True)
    print("failed:", failed)
