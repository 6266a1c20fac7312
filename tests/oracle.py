"""Comparison of a query with its SQL twin."""

import math
from pathlib import Path

import duckdb


def views(folder):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if hasattr(v, "as_tuple"):
        return repr(round(float(v), 6))
    if getattr(v, "tzinfo", None) is not None:
        v = v.replace(tzinfo=None)
    return repr(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


def assert_same(df, connection, sql):
    got, want = df.collect(), connection.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, want.fetchall())
