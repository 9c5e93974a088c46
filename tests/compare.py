"""Run a registered query on Spark and its SQL on DuckDB and compare the bags of rows."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark, con, query, sql, sf_dir) -> tuple[list[str], int, list, list]:
    """Column mismatch, row count, rows only in Spark, rows only in DuckDB (a few each)."""
    df = query(spark, sf_dir)
    spark_rows = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    sql_columns = [c[0] for c in result.description]
    sql_rows = result.fetchall()
    wrong = sorted(set(df.columns) ^ set(sql_columns))
    if wrong:
        return wrong, len(spark_rows), [], []
    left, right = bag(df.columns, spark_rows), bag(sql_columns, sql_rows)
    return [], len(spark_rows), list((left - right).items())[:3], list((right - left).items())[:3]
