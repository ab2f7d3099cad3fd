"""Sketches that are merged against sketches of everything, and both against exact results."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import sketches as sk


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.randrange(40), rng.choice([rng.gauss(0, 9), 1.0, None])) for _ in range(30_000)]
    return spark.createDataFrame(rows, "g string, day int, v double").cache()


def test_merged_quantiles_stay_within_their_rank_error(values):
    probs = (0.01, 0.25, 0.5, 0.9, 0.99)
    merged = sk.merge_quantiles(sk.quantile_sketches(values, ["g", "day"], "v"), ["g"])
    n = {r["g"]: r["n_values"] for r in merged.collect()}
    assert n == {r["g"]: r["n"] for r in values.groupBy("g").agg(F.count("v").alias("n")).collect()}
    off = sk.rank_off(values, sk.sketched_quantiles(merged, probs), "g", "v", probs).collect()
    assert len(off) == 2 and all(r["rank_off"] <= sk.RANK_MARGIN * sk.rank_error() for r in off)


def test_a_wrong_quantile_is_seen(values):
    wrong = values.select("g").distinct().select("g", F.lit(-5.0).alias("q50"))
    assert all(r["rank_off"] > 0.1 for r in sk.rank_off(values, wrong, "g", "v", (0.5,)).collect())


def test_groups_without_values_have_no_sketch(spark):
    none = spark.createDataFrame([("a", None), ("b", 1.0)], "g string, v double")
    assert [r["g"] for r in sk.quantile_sketches(none, ["g"], "v").collect()] == ["b"]
    assert sk.merge_quantiles(sk.quantile_sketches(none.limit(0), ["g"], "v"), ["g"]).collect() == []


def test_unions_equal_direct_sketches_while_exact(spark):
    rows = [(y, m, s) for y in (1, 2, 3) for m in range(4) for s in range(y * 100, y * 100 + 40 * (m + 2))]
    df = spark.createDataFrame([*rows, (1, 1, None)], "year int, month int, s long")
    merged = sk.merge_sets(sk.set_sketches(df, ["year", "month"], "s"), ["year"])
    direct = sk.merge_sets(sk.set_sketches(df, ["year"], "s"), ["year"])
    exact = {r["year"]: r["n"] for r in df.groupBy("year").agg(F.count_distinct("s").alias("n")).collect()}
    for found in (merged, direct):
        assert {r["year"]: r["n_approx"] for r in found.collect()} == exact
    got = {r["year"]: (r["kept_approx"], r["lost_approx"], r["gained_approx"]) for r in sk.turnover_of(merged, "year").collect()}
    sets = {y: {s for a, _, s in rows if a == y} for y in (1, 2, 3)}
    assert got == {
        y: (len(sets[y] & sets[y + 1]), len(sets[y] - sets[y + 1]), len(sets[y + 1] - sets[y])) for y in (1, 2)
    }


def test_large_sets_stay_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 2).cast("int").alias("year"), (F.col("id") % 20_000).alias("s"))
    both = df.unionByName(spark.range(9_000).select(F.lit(1).alias("year"), F.col("id").alias("s")))
    sketched = sk.set_sketches(both.withColumn("month", F.col("s") % 7), ["year", "month"], "s")
    exact = {r["year"]: r["n"] for r in both.groupBy("year").agg(F.count_distinct("s").alias("n")).collect()}
    for r in sk.merge_sets(sketched, ["year"]).collect():
        assert abs(r["n_approx"] - exact[r["year"]]) <= sk.COUNT_MARGIN * sk.count_error() * exact[r["year"]]
