"""Run a query in Spark and its SQL in DuckDB and compare names, types and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _rows(rows, order):
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(spark_df, connection, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    mine = dict(spark_df.dtypes)
    if sorted(names) != sorted(mine):
        return f"columns {sorted(mine)} != {sorted(names)}"
    wrong = {n: (mine[n], types[n]) for n in names if TYPES.get(mine[n]) != types[n]}
    if wrong:
        return f"types {wrong}"
    order = sorted(names)
    expected = _rows(cursor.fetchall(), [names.index(n) for n in order])
    got = _rows([tuple(r) for r in spark_df.collect()], [spark_df.columns.index(n) for n in order])
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}"
    for a, b in zip(got, expected):
        if a != b:
            return f"{order}: spark {str(a)[:400]} != sql {str(b)[:400]}"
    return None
