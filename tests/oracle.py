"""Compare a query's rows with those of its SQL in DuckDB."""

import glob
import math
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def both(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns), (df.columns, rel.columns)
    return rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
