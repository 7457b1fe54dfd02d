"""Compares a query's rows with those of its SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return bytes(v) if isinstance(v, bytearray) else v


def same(df, sql, sf_dir):
    rel = duck(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    key = lambda r: tuple(repr(x) for x in r)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in order) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b, (a, b)
