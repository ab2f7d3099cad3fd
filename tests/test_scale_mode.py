"""Registered queries with every large-input path forced on, still equal to their SQL.

No join is broadcast by size, groups of more than 40 rows count as hot, and no
counted table is small enough to broadcast.
"""

import pytest

from flowloom.operators import iterate, spread, windows
from flowloom.plans import ORACLES, QUERIES
from oracle import connect, differences

SMALL = "/root/testdata/sf0.001"
NAMES = [
    "asof_last_click",
    "band_clicks_before_purchase",
    "clustering",
    "connected_components",
    "core_numbers",
    "flow_facts",
    "full_outer_both_ways",
    "hits",
    "k_core",
    "label_propagation",
    "pagerank_trade",
    "projection_strength",
    "quantiles",
    "rank_largest_quantities",
    "rank_many_order_totals",
    "rolling_6_hours",
    "route_summary",
    "sankey_links",
    "sender_distribution",
    "share_of_source",
    "shared_senders_of_rank_neighbours",
    "strong_edges",
    "transitions",
    "triangle_count_all",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.fixture
def large_paths(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS_PER_TASK", 40)
    monkeypatch.setattr(iterate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(windows, "BROADCAST_ROWS", 0)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", NAMES)
def test_large_paths_match_sql(spark, duck, large_paths, name):
    assert differences(QUERIES[name](spark, SMALL), duck, ORACLES[name]) == []


def test_skewed_fact_join_is_split(spark, sf_dir, large_paths):
    """With half of the line items under one order, the sort-merge join is cut up."""
    from pyspark.sql import functions as F

    from flowloom.sources import scan

    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        from flowloom.operators.flows import flow_facts

        def table(name, cols=None, pred=None):
            df = scan(spark, sf_dir, name, cols, pred)
            if name == "lineitem":
                hot = F.when(F.rand(3) < 0.5, F.lit(1)).otherwise(F.col("l_orderkey"))
                df = df.repartition(8).withColumn("l_orderkey", hot)
            return df

        flows = flow_facts(table, asset=False)
        flows.count()
        flows = flows.groupBy("src").count()
        flows.collect()
        assert "skew=true" in flows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
