"""Runs a query in Spark and its SQL in DuckDB on the same tables, and compares the rows."""

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def clean(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, sf_dir, query, sql):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) and glob.glob(path) else path}'")
    df = query(spark, sf_dir)
    got, r = rows_of(df.columns, [tuple(x) for x in df.collect()]), con.sql(sql)
    want = rows_of(r.columns, r.fetchall())
    if sorted(df.columns) != sorted(r.columns):
        return [f"columns {sorted(df.columns)} and {sorted(r.columns)}"]
    return [] if got == want else [f"{len(got)} and {len(want)} rows", *[f"{a} | {b}" for a, b in zip(got, want, strict=False) if a != b][:2]]
