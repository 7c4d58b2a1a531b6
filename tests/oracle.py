"""Rows of a query and of its DuckDB SQL, made comparable."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 5) + 0.0
    return value if value is None or isinstance(value, (int, bool, str)) else str(value)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(c: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    done = c.execute(sql)
    found = [x[0] for x in done.description]
    names = sorted(found)
    order = [found.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in done.fetchall()), key=repr)
