"""Row-level, relational and time-series operators on hand-made flows."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.functions import fixed, net_value, ratio
from flowloom.operators import aggregates as agg
from flowloom.operators import flows as fl
from flowloom.operators import graph, joins, sets, windows

SCHEMA = (
    "src int, dst int, sender bigint, receiver bigint, asset string, ts timestamp_ntz, "
    "qty decimal(18,2), value decimal(18,4)"
)


def flow(src, dst, sender, receiver, asset, day, qty, value):
    ts = datetime(1999, 1, day) if isinstance(day, int) else day
    return (src, dst, sender, receiver, asset, ts, Decimal(qty), None if value is None else Decimal(value))


ROWS = [
    flow(1, 2, 10, 20, "A", 1, 5, 100),
    flow(1, 2, 10, 20, "A", 1, 5, 100),
    flow(1, 2, 11, 20, "B", 4, 1, 50),
    flow(2, 1, 12, 21, "A", 2, 2, 30),
    flow(2, 2, 12, 22, None, 2, 2, 0),
    flow(3, 1, 13, 21, "C", 9, 7, None),
    flow(3, 3, 13, 23, "C", 9, 7, 70000),
]


@pytest.fixture(scope="module")
def f(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_money_from_doubles(spark):
    df = spark.createDataFrame([(104997.88, 0.07), (0.01, 0.1), (None, 0.1)], "p double, d double")
    got = [r[0] for r in df.select(net_value(F.col("p"), F.col("d"))).collect()]
    assert got == [Decimal("97648.0284"), Decimal("0.0090"), None]
    assert df.select(fixed(F.col("p"), 2)).first()[0] == Decimal("104997.88")


def test_ratio_by_zero_is_null(spark):
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0))).first()[0] is None


def test_value_band_knows_null(f):
    bands = {r["band"] for r in fl.with_value_band(f).collect()}
    assert bands == {"SMALL", "LARGE", "UNKNOWN"}


def test_route_label_does_not_cut_long_keys(spark):
    df = spark.createDataFrame([(7, 12), (1234, 5), (None, 5)], "src int, dst int")
    assert [r["route"] for r in fl.with_route_label(df).collect()] == ["007>012", "1234>005", None]


def test_filter_is_half_open(f):
    assert fl.filter_flows(f, "1999-01-01", "1999-01-02").count() == 2
    assert fl.filter_flows(f, "1999-01-02", "1999-01-04", assets=["A"]).count() == 1


def test_dedup_keeps_one_row_per_key(f):
    got = fl.dedup(f, ["sender", "receiver"], [F.col("ts").desc(), F.col("value").desc_nulls_last()])
    assert got.count() == f.select("sender", "receiver").distinct().count()


def test_dedup_cuts_before_the_shuffle(f):
    plan = fl.dedup(f, ["sender"], [F.col("ts")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_assets_per_route_skips_null(f):
    got = {(r["src"], r["dst"]): r["assets"] for r in fl.assets_per_route(f).collect()}
    assert got[(1, 2)] == ["A", "B"] and got[(2, 2)] == []


def test_summary_of_nothing(empty):
    assert agg.route_summary(empty).count() == 0
    assert graph.graph_stats(graph.edges(empty)).first()["n_nodes"] == 0


def test_summary_with_null_value(f):
    got = {(r["src"], r["dst"]): r for r in agg.route_summary(f).collect()}
    assert got[(3, 1)]["total_value"] is None and got[(3, 1)]["n_flows"] == 1
    assert got[(2, 2)]["mean_value"] == 0.0 and got[(2, 2)]["n_assets"] == 0


def test_rollup_total_equals_plain_total(f):
    top = agg.rolled_up(f, ["src", "dst"]).filter("all_src = 1 AND all_dst = 1").first()
    assert top["total_value"] == f.agg(F.sum("value")).first()[0]
    assert top["n_flows"] == len(ROWS)


def test_grouping_sets_tell_null_from_total(f):
    got = agg.grouped_by_sets(f, [["asset"], []], ["asset"]).collect()
    null_rows = [(r["all_asset"], r["n_flows"]) for r in got if r["asset"] is None]
    assert sorted(null_rows) == [(0, 1), (1, len(ROWS))]


def test_melt_undoes_the_matrix(f):
    wide = agg.route_matrix(f, [1, 2, 3])
    long = agg.melt(wide, ["src"], "route", "n_flows")
    back = {(r["src"], int(r["route"][3:])): r["n_flows"] for r in long.collect() if r["n_flows"]}
    assert back == {(r["src"], r["dst"]): r["count"] for r in f.groupBy("src", "dst").count().collect()}


def test_histogram_keeps_outliers(f):
    got = {r["bin"]: r["n_flows"] for r in agg.histogram(f, "value", 10, 110, 10).collect()}
    assert got == {0: 1, 3: 1, 5: 1, 10: 2, 11: 1, None: 1}


def test_both_ways_fills_the_missing_side(f):
    got = {(r["a"], r["b"]): (r["forward"], r["backward"]) for r in joins.both_ways(graph.edges(f)).collect()}
    assert got[(1, 2)] == (250, 30) and (2, 2) not in got


def test_net_flow_agrees_with_the_join(f):
    e = graph.edges(f.filter("value IS NOT NULL"))
    left = graph.net_flow(e).select("a", "b", "forward", "backward")
    assert sorted(left.collect()) == sorted(joins.both_ways(e).collect())


def test_active_and_inactive_cover_everyone(f):
    who = f.select("sender").distinct()
    january = fl.filter_flows(f, "1999-01-01", "1999-01-03")
    assert {r[0] for r in joins.active(who, january, "sender").collect()} == {10, 12}
    assert {r[0] for r in joins.inactive(who, january, "sender").collect()} == {11, 13}


def test_unknown_join_type_is_refused(f):
    with pytest.raises(ValueError):
        joins.equi_join(f, f, "src", "cross")


def test_turnover(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "sender bigint")
    b = spark.createDataFrame([(2,), (3,), (None,)], "sender bigint")
    got = {r["sender"]: r["status"] for r in sets.turnover(a, b).collect()}
    assert got == {1: "lost", 2: "kept", 3: "new", None: "kept"}


def test_all_forms_count_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,)], "sender bigint")
    b = spark.createDataFrame([(1,), (1,), (3,)], "sender bigint")
    assert sorted(r[0] for r in sets.intersect_all(a, b).collect()) == [1, 1]
    assert sorted(r[0] for r in sets.except_all(a, b).collect()) == [1, 2]
    assert sets.union_all(a, b).count() == 7
    assert sets.union_distinct(a, b).count() == 3


def test_gaps_are_filled_per_source(f):
    daily = windows.resample(f, "day", ["src"])
    filled = windows.fill_gaps(daily, ["src"])
    assert filled.count() == 3 * 9
    assert filled.agg(F.sum("n_flows")).first()[0] == len(ROWS)


def test_rolling_total_over_filled_days(f):
    daily = windows.fill_gaps(windows.resample(f, "day", ["src"]), ["src"])
    got = {
        (r["src"], r["period"].day): r["n_rolling"]
        for r in windows.rolling(daily, ["src"], 3).collect()
    }
    assert got[(1, 3)] == 2 and got[(1, 4)] == 1 and got[(1, 7)] == 0


def test_period_change_starts_with_null_and_survives_zero(f):
    m = windows.resample(f.filter("src = 2"), "day", ["src", "dst"])
    assert all(r["change"] is None for r in windows.period_change(m, ["src", "dst"]).collect())
    two = m.withColumn("total_value", F.lit(0).cast("decimal(38,4)")).unionByName(
        m.withColumn("period", F.col("period") + F.expr("INTERVAL 1 DAY"))
    )
    later = windows.period_change(two, ["src", "dst"]).filter("change IS NOT NULL").collect()
    assert later and all(r["growth"] is None for r in later)


def test_top_n_ranks_keep_ties(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 4), (1, 3), (2, 9)], "g int, total_value int")
    order = [F.col("total_value").desc()]
    assert windows.top_n(df, ["g"], order, 1).count() == 2
    assert windows.top_ranks(df, ["g"], "total_value", 1).count() == 3


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("many", [True, False])
def test_top_ranks_equal_builtin_functions(spark, monkeypatch, dense, small, many):
    if not small:
        monkeypatch.setattr(windows, "BROADCAST_ROWS", 0)
    if many:
        monkeypatch.setattr(windows, "GROUP_LIMIT", 7)
    data = [(i % 4 or None, None if i % 9 == 0 else i % 6, i) for i in range(80)]
    df = spark.createDataFrame(data, "g int, v int, id int")
    rank = F.dense_rank if dense else F.rank
    place = rank().over(Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last()))
    want = df.withColumn("place", place).filter("place <= 8")
    got = windows.top_ranks(df, ["g"], "v", 8, dense, rows_per_task=3)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("dense", [True, False])
def test_top_5000_of_a_hot_group_is_exact(spark, dense):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(7).alias("g"),
        F.floor(F.col("id") / 2).cast("decimal(20,0)").alias("v"),
        "id",
    )
    rank = F.dense_rank if dense else F.rank
    place = rank().over(Window.partitionBy("g").orderBy(F.col("v").desc()))
    want = rows.withColumn("place", place).filter("place <= 5000")
    got = windows.top_ranks(rows, ["g"], "v", 5000, dense, rows_per_task=1000).select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("limit", [1, None])
def test_shares_of_a_source_sum_to_one(f, limit):
    routes = f.groupBy("src", "dst").agg(F.sum("value").cast("decimal(38,4)").alias("total_value"))
    got = {(r["src"], r["dst"]): r["share"] for r in windows.share(routes, ["src"], limit).collect()}
    assert got == {(1, 2): 1.0, (2, 1): 1.0, (2, 2): 0.0, (3, 1): None, (3, 3): 1.0}


def test_top_plus_other_keeps_the_total(f):
    moved = f.groupBy("src", "asset").agg(F.sum("value").cast("decimal(38,4)").alias("total_value"))
    got = windows.top_n_plus_other(moved, ["src"], "asset", 1)
    assert {(r["src"], r["asset"]) for r in got.collect()} == {
        (1, "A"), (1, "OTHER"), (2, "A"), (2, "OTHER"), (3, "C"),
    }
    assert got.agg(F.sum("total_value")).first()[0] == f.agg(F.sum("value")).first()[0]


def test_concentration_of_one_route_is_one(f):
    routes = f.filter("src = 1").groupBy("src", "dst").agg(F.sum("value").alias("total_value"))
    assert windows.concentration(routes, ["src"]).first()["concentration"] == 1.0


@pytest.mark.parametrize("limit", [4, None])
def test_distribution_equals_builtin_functions(spark, limit):
    data = [(i % 3 if i % 3 else None if i % 2 else 0, None if i % 23 == 0 else i % 7, i) for i in range(100)]
    df = spark.createDataFrame(data, "g int, v int, id int")
    got = windows.distribution(df, "g", "v", "id", 4, limit)
    ordered = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first(), "id")
    peers = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first())
    want = df.select(
        "*",
        F.ntile(4).over(ordered).alias("tile"),
        F.round(F.percent_rank().over(peers), 9).alias("percent_rank"),
        F.round(F.cume_dist().over(peers), 9).alias("cume_dist"),
    )
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_results_do_not_depend_on_partitioning(f):
    shuffled = f.repartition(5, "receiver").orderBy(F.rand(1))
    for op in (agg.route_summary, graph.edges, fl.assets_per_route):
        assert sorted(map(repr, op(f).collect())) == sorted(map(repr, op(shuffled).collect()))
