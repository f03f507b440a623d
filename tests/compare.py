"""Compares a query's rows with those of its SQL in DuckDB, whatever the order."""

import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if hasattr(v, "isoformat"):
        return str(v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


def check(spark, query, sql, folder):
    df = query(spark, folder)
    found = connect(folder).execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())
