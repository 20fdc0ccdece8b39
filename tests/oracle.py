"""Compares a query's rows with its SQL's on DuckDB: names, and values of rows in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(rows):
    return sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def same(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = _plain(tuple(r[n] for n in names) for r in df.collect())
    out = con.execute(sql)
    there = [d[0] for d in out.description]
    assert sorted(there) == names
    at = [there.index(n) for n in names]
    want = _plain(tuple(r[i] for i in at) for r in out.fetchall())
    assert got == want
    return len(got)
