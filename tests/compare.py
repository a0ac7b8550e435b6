"""Side-by-side comparison of a Spark result with its DuckDB query."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(folder: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, int):
        return value
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return str(value)


SPARK_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
               "date": "DATE", "boolean": "BOOLEAN", "float": "FLOAT"}


def compare(frame, connection, sql: str) -> list[str]:
    """Differences in columns, types, row count and values; empty when equal."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected_rows = cursor.fetchall()
    problems = []
    order = sorted(frame.columns)
    if order != sorted(names):
        return [f"columns {order} != {sorted(names)}"]
    for name, kind in frame.dtypes:
        if SPARK_NAMES.get(kind, kind) != types[name]:
            problems.append(f"type {name}: {kind} != {types[name]}")
    actual = sorted((tuple(cell(r[c]) for c in order) for r in frame.collect()), key=str)
    index = [names.index(c) for c in order]
    expected = sorted((tuple(cell(r[i]) for i in index) for r in expected_rows), key=str)
    if len(actual) != len(expected):
        problems.append(f"rows {len(actual)} != {len(expected)}")
    if actual != expected:
        left, right = set(actual), set(expected)
        only = list(left - right)[:3], list(right - left)[:3]
        problems.append(f"values of {order}: spark only {only[0]} duckdb only {only[1]} ({len(left-right)})")
    if not expected:
        problems.append("EMPTY")
    return problems
