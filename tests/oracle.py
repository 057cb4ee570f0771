"""Comparison of a query with its SQL over the same tables."""

import glob
import os

import duckdb


def _plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, float):
        return f"{v:.9g}"
    return "" if v is None else str(v)


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def same(spark, con, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(_plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
