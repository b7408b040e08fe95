"""Run a query and its SQL side by side."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def same(con, sql, df):
    rel = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(value(r[i]) for i in at) for r in rel.fetchall()), key=key)
    got = sorted((tuple(value(r[n]) for n in names) for r in df.collect()), key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
