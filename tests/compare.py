"""Runs a query in Spark and its SQL in DuckDB over the same files and compares the rows."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def both(spark, name, query, sql):
    df = query(spark, SF_DIR)
    columns = sorted(df.columns)
    spark_rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck().execute(sql)
    names = [d[0] for d in cursor.description]
    duck_rows = sorted((tuple(plain(v) for _, v in sorted(zip(names, r))) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == columns, name
    return spark_rows, duck_rows
