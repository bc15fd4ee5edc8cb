"""Compares a query with its SQL in DuckDB over the same files."""

import math
import os

import duckdb


def connection(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def assert_equal(df, sql, sf):
    result = connection(sf).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want
