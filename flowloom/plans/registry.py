"""Names to queries, names to SQL, and the pieces several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where plain SQL can say the same, that SQL."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


VALUE = (
    "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
    " AS DECIMAL(18,4))"
)

FLOWS = f"""flows AS (
  SELECT c_nationkey AS src, s_nationkey AS dst, c_custkey AS sender, s_suppkey AS receiver,
         p_brand AS asset, o_orderdate AS ts, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
         {VALUE} AS value
  FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN supplier ON s_suppkey = l_suppkey
  JOIN part ON p_partkey = l_partkey)"""

# For queries that do not look at assets.
PLAIN_FLOWS = f"""flows AS (
  SELECT c_nationkey AS src, s_nationkey AS dst, c_custkey AS sender, s_suppkey AS receiver,
         o_orderdate AS ts, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
         {VALUE} AS value
  FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN supplier ON s_suppkey = l_suppkey)"""

EDGES = """edges AS (
  SELECT src, dst, CAST(sum(value) AS DECIMAL(38,4)) AS weight, count(*) AS n_flows
  FROM flows GROUP BY ALL)"""

TRADE = """edges AS (
  SELECT sender * 2 AS src, receiver * 2 + 1 AS dst,
         CAST(sum(value) AS DECIMAL(38,4)) AS weight, count(*) AS n_flows
  FROM flows GROUP BY ALL)"""


def strong(share: float) -> str:
    """Edges with at least ``share`` of what their source sends."""
    return f"""strong AS MATERIALIZED (
  SELECT src, dst, weight, n_flows FROM edges
  QUALIFY CAST(weight AS DOUBLE)
          >= CAST(sum(weight) OVER (PARTITION BY src) AS DOUBLE) * {share})"""


def with_sql(*ctes: str, select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + select
