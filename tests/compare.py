"""Spark against DuckDB: same columns, same types by family, same rows in any order."""

import math
from decimal import Decimal

import duckdb

from catalog.inputs import TABLES


def connect(folder):
    connection = duckdb.connect()
    connection.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark_frame, connection, sql):
    """What differs, as short text; empty when nothing does."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(spark_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(names)}"
    got = rows_of(spark_frame.columns, [tuple(row) for row in spark_frame.collect()])
    wanted = rows_of(names, expected)
    if len(got) != len(wanted):
        return f"{len(got)} rows and {len(wanted)}"
    for left, right in zip(got, wanted):
        if left != right:
            return f"{str(left)[:600]} and {str(right)[:600]}"
    return ""
