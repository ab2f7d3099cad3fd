"""Comparing a Spark result with its SQL in DuckDB, type by type and row by row."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

SAME_TYPE = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "array<string>": "VARCHAR[]",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def rows(names, data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in data)


def differences(df, con, sql: str) -> list[str]:
    """What differs; empty if names, types and rows agree."""
    rel = con.sql(sql)
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    found = []
    if sorted(spark_types) != sorted(duck_types):
        return [f"columns {sorted(spark_types)} against {sorted(duck_types)}"]
    for name, t in spark_types.items():
        if SAME_TYPE.get(t, t.upper()) != duck_types[name]:
            found.append(f"{name} is {t} against {duck_types[name]}")
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = rows(rel.columns, rel.fetchall())
    if got != want:
        extra, missing = got - want, want - got
        found.append(
            f"{sum(got.values())} rows against {sum(want.values())}; "
            f"extra {list(extra)[:2]}, missing {list(missing)[:2]}"
        )
    return found
