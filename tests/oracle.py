"""Compare Spark results with DuckDB results on the same parquet tables."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df) -> list[tuple]:
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str) -> tuple[list[str], list[str], list[tuple]]:
    rel = con.sql(sql)
    return list(rel.columns), [str(x) for x in rel.types], _rows(list(rel.columns), rel.fetchall())


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(df, con, sql: str) -> list[str]:
    """Problems found; empty when columns, types and values agree."""
    columns, types, expected = duck_rows(con, sql)
    problems = []
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    duck_types = dict(zip(columns, types))
    for name, kind in df.dtypes:
        if SPARK_TYPES.get(kind, kind) != duck_types[name]:
            problems.append(f"type of {name}: {kind} != {duck_types[name]}")
    got = spark_rows(df)
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} != {len(expected)}")
    if got != expected:
        a, b = set(map(repr, got)), set(map(repr, expected))
        problems.append(f"values differ: only spark {sorted(a - b)[:2]} only sql {sorted(b - a)[:2]}")
    return problems
