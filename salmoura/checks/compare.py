"""Compare registered queries with their SQL in DuckDB on the same files."""

from __future__ import annotations

import math
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark: SparkSession, connection, folder: str, run, sql: str | None) -> dict:
    """Row counts, seconds, and the first difference if there is one."""
    start = time.time()
    df = run(spark, folder)
    collected = [tuple(row) for row in df.collect()]
    result = {"rows": len(collected), "seconds": round(time.time() - start, 2), "ok": True}
    if sql is None:
        return {**result, "checked": "rows only"}
    relation = connection.execute(sql)
    names = [c[0] for c in relation.description]
    mine, theirs = _rows(df.columns, collected), _rows(names, relation.fetchall())
    if sorted(df.columns) != sorted(names):
        return {**result, "ok": False, "why": f"columns {df.columns} / {names}"}
    if len(mine) != len(theirs):
        return {**result, "ok": False, "why": f"rows {len(mine)} / {len(theirs)}"}
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return {**result, "ok": False, "why": f"{sorted(names)}\n  {a}\n  {b}"[:900]}
    return result
