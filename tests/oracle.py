"""Spark and DuckDB side by side, as the driver compares them."""

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def both(spark, sf_dir, make, sql):
    df = make(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=repr)
    rel = connect(sf_dir).sql(sql)
    assert sorted(rel.columns) == columns, (rel.columns, columns)
    want = sorted((tuple(map(plain, r)) for r in rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    return got, want
