"""Rows of a Spark query against those of its SQL."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def views():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def same(spark, con, query, sql) -> bool:
    df = query(spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    out = con.sql(sql)
    at = [out.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)
    assert len(out.columns) == len(cols) and got == want, (got[:3], want[:3])
    return True
