"""Run a query and its SQL over the same tables and compare all rows."""

import decimal
import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(v):
    if v is None or (isinstance(v, (float, np.floating)) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


def assert_same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf_dir).sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == rows(rel.columns, rel.fetchall())
    assert got
