"""Rows of a Spark query against rows of DuckDB SQL over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return round(value, 6) if isinstance(value, float) else value


def same_rows(frame, con, sql):
    found = con.sql(sql)
    names = sorted(frame.columns)
    assert names == sorted(found.columns)
    want = [tuple(plain(r[found.columns.index(n)]) for n in names) for r in found.fetchall()]
    got = [tuple(plain(r[n]) for n in names) for r in frame.select(*[f"`{n}`" for n in names]).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
