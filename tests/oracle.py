"""Runs a query and its SQL side by side, as the driver does."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def both(spark, f, sql, sf):
    df = f(spark, sf)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(sf, t)}.parquet')")
    r = con.execute(sql)
    at = [d[0] for d in r.description]
    assert sorted(at) == names
    theirs = sorted((tuple(plain(row[at.index(c)]) for c in names) for row in r.fetchall()), key=repr)
    return ours, theirs
