"""Runs a query in Spark and its SQL in DuckDB and compares the rows, whatever their order."""

import math
import os

import duckdb


def plain(x):
    if x is None:
        return None
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, (bool, str, bytes)):
        return x
    try:
        number = float(x)
    except (TypeError, ValueError):
        return str(x)
    return None if math.isnan(number) else float(f"{number:.9g}")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((repr(tuple(plain(r[k]) for k in order)) for r in rows))


def duck(sf_dir, sql):
    base = duckdb.connect()
    base.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        base.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    found = base.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def assert_same(df, sql, sf_dir):
    columns, rows = duck(sf_dir, sql)
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, rows)
