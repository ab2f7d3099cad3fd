"""Table scans, SQL over frames and partitioned reads from a warehouse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

# The layout of the input tables.  Reading with a schema saves
# the job that would look into file footers for one.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
        "c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
        "value double, props string"
    ),
}


def scan(
    spark: SparkSession,
    sf_dir: str,
    table: str,
    cols: Sequence[str] | None = None,
    pred: Column | str | None = None,
) -> DataFrame:
    """Columns of one table, filtered; both reach the parquet reader."""
    df = spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")
    if pred is not None:
        df = df.filter(pred)
    return df.select(*cols) if cols else df


def sql(
    spark: SparkSession, text: str, args: dict | None = None, **frames: DataFrame
) -> DataFrame:
    """Run SQL that names each frame as ``{name}`` and each value as ``:name``."""
    return spark.sql(text, args=args, **frames)


def warehouse_scan(
    spark: SparkSession,
    url: str,
    query: str,
    part_col: str,
    lo: int,
    hi: int,
    n: int,
    **options: str,
) -> DataFrame:
    """Read a warehouse query over JDBC as ``n`` parallel range reads.

    ``lo`` and ``hi`` only set the stride: rows outside them go to the first
    and last read, so none is lost.  The driver jar is the caller's.
    """
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=f"({query}) q",
        partitionColumn=part_col,
        lowerBound=str(lo),
        upperBound=str(hi),
        numPartitions=str(n),
        **options,
    )
    return reader.load()
