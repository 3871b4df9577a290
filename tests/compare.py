"""Rows of a query and of its SQL in DuckDB, in a comparable form."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), sorted(columns)


def check(df, con, sql):
    found, names = normal([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    wanted, other = normal(cursor.fetchall(), columns)
    assert names == other
    assert found == wanted
