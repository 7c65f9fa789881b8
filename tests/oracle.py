"""Runs a query and its SQL on the same tables and compares the rows."""

import datetime
import decimal

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (float, decimal.Decimal)) or type(v).__name__.startswith("float"):
        return f"{float(v):.9g}"
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return pd.Timestamp(v).isoformat()
    return str(v) if not isinstance(v, int) else f"{float(v):.9g}"


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(repr, ([_value(v) for v in r] for r in frame[columns].astype(object).itertuples(index=False))))


def assert_same(spark, query, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    assert rows(query(spark, folder).toPandas()) == rows(con.execute(sql).fetchdf())
