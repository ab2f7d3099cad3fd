"""Cases that once gave wrong rows: missing times, doubles, string ids, names that collide."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowloom.functions import fixed
from flowloom.operators import aggregates as agg
from flowloom.operators import graph, iterate, joins
from flowloom.operators import windows as win

DAY = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double")


@pytest.mark.parametrize("limit", [None, 2])
def test_asof_never_matches_rows_without_time_or_key(spark, limit):
    left = events(spark, [(1, 1, DAY, 0.0), (2, 1, None, 0.0), (3, None, DAY, 0.0), (4, 2, DAY, 0.0)])
    right = events(
        spark,
        [(7, 1, None, 1.0), (8, None, DAY, 2.0), (9, 2, DAY - dt.timedelta(1), 3.0), (10, 2, None, 4.0)],
    )
    got = joins.asof(left.drop("value"), right, "user_id", "ts", "event_id", rows_per_task=limit)
    assert {r["event_id"]: r["prev_event_id"] for r in got.collect()} == {1: None, 2: None, 3: None, 4: 9}


def test_running_totals_refuse_doubles(spark):
    df = events(spark, [(1, 1, DAY, 1e17), (2, 1, DAY, 1.0)])
    with pytest.raises(TypeError, match="decimal"):
        win.rolling_time(df, "user_id", "1 HOUR", F.col("value"))
    with pytest.raises(TypeError, match="decimal"):
        joins.band_totals(df, df, "user_id", "ts", "1 HOUR", F.col("value"))


EDGES = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y")]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "src string, dst string").withColumn("weight", F.lit(1).cast("decimal(38,4)"))


def test_labels_may_be_strings(spark):
    got = {r["node"]: r["label"] for r in iterate.label_propagation(edges(spark), rounds=2).collect()}
    assert got["a"] == got["b"] and set(got) == set("abcdxy")


@pytest.mark.parametrize("limit", [None, 1])
def test_sankey_ids_of_strings(spark, limit):
    got = {(r["src"], r["dst"]): (r["source_id"], r["target_id"]) for r in graph.sankey_links(edges(spark), limit).collect()}
    assert got == {("a", "b"): (0, 4), ("b", "c"): (1, 5), ("a", "c"): (0, 5), ("c", "d"): (2, 6), ("x", "y"): (3, 7)}


def test_a_label_like_the_rest_is_counted_with_it(spark):
    df = spark.createDataFrame(
        [(1, "OTHER", 50), (1, "b", 40), (1, "c", 3), (1, "d", 2)], "src int, asset string, total_value int"
    )
    got = {r["asset"]: int(r["total_value"]) for r in win.top_n_plus_other(df, ["src"], "asset", 2).collect()}
    assert got == {"OTHER": 55, "b": 40}


def test_halves_round_away_from_zero(spark):
    df = spark.createDataFrame([(0.125,), (-0.125,), (0.375,), (2.0,), (None,)], "x double")
    got = [r[0] for r in df.select(fixed(F.col("x"), 2)).collect()]
    assert [None if v is None else str(v) for v in got] == ["0.13", "-0.13", "0.38", "2.00", None]


def test_flows_to_unlisted_places_are_counted(spark):
    f = spark.createDataFrame([(1, 2), (1, 30), (1, None), (2, 2)], "src int, dst int")
    got = {r["src"]: r.asDict() for r in agg.route_matrix(f, [2, 3]).collect()}
    assert got[1] == {"src": 1, "to_2": 1, "to_3": 0, "to_other": 2}
    assert got[2]["to_2"] == 1 and got[2]["to_other"] == 0


def test_places_come_from_a_table_of_checked_size(spark):
    assert agg.listed(spark.range(26), "id") == list(range(26))
    with pytest.raises(ValueError, match="more than"):
        agg.listed(spark.range(26), "id", most=25)


def test_ranks_settle_or_say_so(spark):
    e = edges(spark, EDGES + [("d", "a"), ("y", "x")])
    settled = {r["node"]: r["rank"] for r in iterate.pagerank(e, rounds=200, tol=1e-9).collect()}
    rank = dict.fromkeys(settled, 1 / 6)
    out = {v: [d for s, d in EDGES + [("d", "a"), ("y", "x")] if s == v] for v in rank}
    for _ in range(300):
        new = dict.fromkeys(rank, 0.15 / 6)
        for v, nexts in out.items():
            for d in nexts:
                new[d] += 0.85 * rank[v] / len(nexts)
        rank = new
    assert all(abs(settled[v] - rank[v]) < 1e-7 for v in rank)
    assert abs(sum(r["hub"] for r in iterate.hits(e, rounds=300, tol=1e-9).collect()) - 1) < 1e-9
    with pytest.raises(iterate.NotConverged):
        iterate.pagerank(e, rounds=2, tol=1e-12)
    with pytest.raises(iterate.NotConverged):
        iterate.hits(edges(spark, EDGES), rounds=1, tol=1e-12)


def test_handovers_follow_time_then_receiver(spark):
    rows = [(1, 1, 10), (1, 2, 20), (1, 2, 15), (1, 3, 20), (1, 3, 20), (2, 1, 10), (None, 1, 9), (None, 2, 8)]
    f = spark.createDataFrame(rows, "sender long, ts int, receiver long")
    got = {(r["src"], r["dst"]): int(r["weight"]) for r in graph.handovers(f).collect()}
    assert got == {(10, 15): 1, (15, 20): 1}
