"""Comparison of a query's rows with those of its SQL in DuckDB, in any order."""

import math
import os

import duckdb

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def available():
    return os.path.isdir(SF_DIR)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def key(row):
    return tuple((v is None, isinstance(v, str), str(round(v, 4) + 0.0) if isinstance(v, float) else str(v)) for v in row)


def check(spark, con, query, sql):
    got = query(spark, SF_DIR)
    names = sorted(got.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in got.select(*[f"`{n}`" for n in names]).collect()), key=key)
    con.execute(sql)
    columns = [d[0] for d in con.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in con.fetchall()), key=key)
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        for x, y in zip(a, b):
            assert (math.isclose(x, y, abs_tol=2e-6) if isinstance(x, float) and y is not None else x == y), (a, b)
