"""The flow table and row-level work on it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions import (
    fixed,
    json_field,
    net_value,
    route_label,
    time_parts,
    value_band,
)
from flowloom.sources import scan


def tables(spark: SparkSession, sf_dir: str) -> Callable[..., DataFrame]:
    """``t("orders", ["o_orderkey"])`` scans one table of ``sf_dir``."""

    def table(name: str, cols: Sequence[str] | None = None, pred: Column | None = None):
        return scan(spark, sf_dir, name, cols, pred)

    return table


def flow_facts(
    t: Callable[..., DataFrame],
    asset: bool = True,
    lines: Column | None = None,
    orders: Column | None = None,
) -> DataFrame:
    """One row per line item: what moved, from where to where, when and for how much.

    ``lines`` and ``orders`` filter the two large tables before any join.
    ``asset=False`` leaves out the asset column and with it the join to part.

    The order-side tables are joined first, so the line items meet them
    in one join; they are shuffled again for suppliers and parts where those are too
    large to broadcast.  No side carries a broadcast hint: Spark broadcasts a side whose
    file or shuffle size is under its threshold and otherwise sorts and merges,
    splitting skewed keys.  Money is decimal from the first operation on, and
    18 digits keep a value in one long.
    """
    line = t("lineitem", pred=lines).select(
        "l_orderkey",
        "l_suppkey",
        *(["l_partkey"] if asset else []),
        fixed(F.col("l_quantity"), 2).alias("qty"),
        net_value(F.col("l_extendedprice"), F.col("l_discount")).alias("value"),
    )
    order = t("orders", pred=orders).select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("sender"),
        F.col("o_orderdate").alias("ts"),
    )
    sender = t("customer").select(
        F.col("c_custkey").alias("sender"), F.col("c_nationkey").alias("src")
    )
    receiver = t("supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")
    )
    flows = line.join(order.join(sender, "sender"), "l_orderkey").join(receiver, "l_suppkey")
    columns = ["src", "dst", "sender", F.col("l_suppkey").alias("receiver")]
    if asset:
        part = t("part").select(
            F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("asset")
        )
        flows = flows.join(part, "l_partkey")
        columns.append("asset")
    return flows.select(*columns, "ts", "qty", "value")


def filter_flows(
    f: DataFrame,
    t0: str | None = None,
    t1: str | None = None,
    assets: Sequence[str] | None = None,
    src: Sequence[int] | None = None,
    dst: Sequence[int] | None = None,
) -> DataFrame:
    """Flows with ``t0 <= ts < t1`` and with the given assets and places."""
    if t0 is not None:
        f = f.filter(F.col("ts") >= F.lit(t0).cast("timestamp_ntz"))
    if t1 is not None:
        f = f.filter(F.col("ts") < F.lit(t1).cast("timestamp_ntz"))
    for name, wanted in (("asset", assets), ("src", src), ("dst", dst)):
        if wanted is not None:
            f = f.filter(F.col(name).isin(*wanted))
    return f


def enrich(f: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Nation and region names for both ends."""
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    for end in ("src", "dst"):
        named = place.select(
            F.col("n_nationkey").alias(end),
            F.col("n_name").alias(f"{end}_nation"),
            F.col("r_name").alias(f"{end}_region"),
        )
        f = f.join(named, end)
    return f


def with_time_parts(f: DataFrame) -> DataFrame:
    return f.withColumns(time_parts(F.col("ts")))


def with_route_label(f: DataFrame) -> DataFrame:
    return f.withColumn("route", route_label(F.col("src"), F.col("dst")))


def with_value_band(f: DataFrame) -> DataFrame:
    return f.withColumn("band", value_band(F.col("value")))


def with_json_field(events: DataFrame, path: str, dtype: str, name: str) -> DataFrame:
    return events.withColumn(name, json_field(F.col("props"), path, dtype))


def assets_per_route(f: DataFrame) -> DataFrame:
    """Sorted distinct assets of each route.

    Duplicates go before the arrays are built, map-side first, so an array has
    at most one entry per asset of the dictionary, however many rows there are.
    """
    return (
        f.select("src", "dst", "asset")
        .distinct()
        .groupBy("src", "dst")
        .agg(F.sort_array(F.collect_list("asset")).alias("assets"))
    )


def dedup(f: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in a total order.

    Spark turns ``row_number() <= 1`` into a limit that runs before the
    shuffle, so a hot key sends one row per input split.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return f.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 1").drop("_rn")
