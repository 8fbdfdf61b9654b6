"""Holds a query against its SQL on the same tables."""

import os

DATA = "/root/testdata/sf0.001"


def same(spark, query, text, sf_dir=DATA):
    """Whether both give the same columns and rows, in any order."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))
    want = sorted(map(repr, con.sql(f"SELECT {', '.join(names)} FROM ({text})").fetchall()))
    assert got == want
