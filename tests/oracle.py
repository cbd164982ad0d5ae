"""Rows of a query and of its SQL in one comparable form."""

import glob
import math
import os

import duckdb


def connected(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        g = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{g}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


def same(spark_df, connection, sql):
    columns = sorted(spark_df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in (x.asDict() for x in spark_df.collect()))
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    assert not wrong, wrong[:3]
