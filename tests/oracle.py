"""Comparing a query with its SQL in DuckDB."""

import datetime
import decimal
import math
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for name in sorted(os.listdir(folder)):
        path = f"{folder}/{name}"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"create view \"{name[: -len('.parquet')]}\" as select * from '{path}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def same_rows(df, connection, sql):
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in result.fetchall())
    assert got == want
    return len(got)
