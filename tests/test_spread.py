"""Hot-key handling must not change any result; a tiny row limit forces it on."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.operators.joins import asof
from flowloom.operators.spread import hot_keys, join_spread, running, with_chunks

LIMIT = 5


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows under one key, many under NULL, ties and NULLs in the order."""
    rnd = random.Random(7)
    data = []
    for i in range(300):
        key = 1 if i % 3 == 0 else None if i % 3 == 1 and i % 2 else rnd.randrange(2, 40)
        at = None if i % 17 == 0 else float(rnd.randrange(0, 25))
        value = None if i % 11 == 0 else rnd.randrange(-9, 10)
        data.append((key, at, i, value))
    return spark.createDataFrame(data, "k int, at double, id int, v int").cache()


def as_set(df):
    return sorted(map(repr, df.collect()))


def test_hot_keys_finds_only_large_groups(rows):
    counts = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    found = {r["k"]: r["_parts"] for r in hot_keys(rows, ["k"], 20).collect()}
    assert set(found) == {k for k, n in counts.items() if n > 20}
    assert all(parts >= 2 for parts in found.values())


def test_chunks_follow_the_order(rows):
    cut = with_chunks(rows, ["k"], ["at", "id"], LIMIT)
    assert cut.count() == rows.count()
    per_key = {}
    for r in cut.filter("at is not null").collect():
        per_key.setdefault(r["k"], []).append((r["at"], r["_chunk"]))
    for pairs in per_key.values():
        pairs.sort()
        chunks = [c for _, c in pairs]
        assert chunks == sorted(chunks)
    assert cut.filter("k = 1").select("_chunk").distinct().count() > 5


@pytest.mark.parametrize("peers", [False, True])
@pytest.mark.parametrize("limit", [LIMIT, None])
def test_running_sums_equal_plain_windows(rows, peers, limit):
    order = ["at"] if peers else ["at", "id"]
    got = running(
        rows, ["k"], order, sums={"s": F.col("v")}, totals={"t": F.col("v")}, peers=peers,
        rows_per_task=limit,
    )
    w = Window.partitionBy("k").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    frame = (w.rangeBetween if peers else w.rowsBetween)(Window.unboundedPreceding, 0)
    want = rows.select(
        "*",
        F.coalesce(F.sum("v").over(frame), F.lit(0)).alias("s"),
        F.sum("v").over(Window.partitionBy("k")).alias("t"),
    )
    assert as_set(got) == as_set(want)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("limit", [LIMIT, None])
def test_carried_values_equal_plain_windows(rows, inclusive, limit):
    got = running(
        rows, ["k"], ["at", "id"], lasts={"p": F.col("v")}, inclusive=inclusive, rows_per_task=limit
    )
    w = Window.partitionBy("k").orderBy(F.col("at").asc_nulls_first(), "id")
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.withColumn("p", F.last("v", ignorenulls=True).over(frame))
    assert as_set(got) == as_set(want)


def test_running_takes_the_plain_window_when_counted_small(rows):
    small = running(rows, ["k"], ["at", "id"], sums={"s": F.col("v")}, total=300)
    large = running(rows, ["k"], ["at", "id"], sums={"s": F.col("v")}, rows_per_task=LIMIT)
    assert as_set(small) == as_set(large)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("nulls_match", [False, True])
@pytest.mark.parametrize("total", [None, 300])
def test_join_spread_equals_plain_join(spark, rows, how, nulls_match, total):
    names = [(k, f"n{k}") for k in range(30)] + [(1, "again"), (None, "none")]
    small = spark.createDataFrame(names, "k int, name string")
    limit = 1000 if total else LIMIT
    got = join_spread(rows, small, "k", how, limit, nulls_match=nulls_match, total=total)
    renamed = small.withColumnRenamed("k", "k2")
    same = F.col("k").eqNullSafe(F.col("k2")) if nulls_match else F.col("k") == F.col("k2")
    want = rows.join(renamed, same, how).drop("k2")
    assert as_set(got.select(*want.columns)) == as_set(want)


def test_running_on_infinite_and_nan_order(spark):
    data = [(1, x, i, 1) for i, x in enumerate([float("nan"), float("inf"), -float("inf"), 0.0, 1.0] * 4)]
    df = spark.createDataFrame(data, "k int, at double, id int, v int")
    got = running(df, ["k"], ["at", "id"], sums={"s": F.col("v")}, rows_per_task=3)
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert as_set(got) == as_set(df.withColumn("s", F.sum("v").over(w)))


def test_empty_input(spark):
    df = spark.createDataFrame([], "k int, at double, id int, v int")
    assert running(df, ["k"], ["at"], sums={"s": F.col("v")}).count() == 0
    assert join_spread(df, df.select("k", F.col("v").alias("w")), "k").count() == 0


@pytest.mark.parametrize("shape", ["outlier", "heavy tail", "ties", "strings", "decimals", "dates"])
def test_pieces_hold_about_equal_rows(spark, shape):
    n, limit = 20_000, 1000
    base = spark.range(n).withColumn("k", F.lit(1))
    at = {
        "outlier": F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") / n),
        "heavy tail": F.exp(F.col("id") / 400),
        "ties": F.floor(F.col("id") / 10_000),
        "strings": F.format_string("same start %06d", "id"),
        "decimals": (F.col("id") + F.lit("12345678901234567890123456789").cast("decimal(38,0)")).cast("decimal(38,0)"),
        "dates": F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("id") / 100).cast("int")),
    }[shape]
    df = base.withColumn("at", at)
    sizes = [r["count"] for r in with_chunks(df, ["k"], ["at", "id"], limit).groupBy("_chunk").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 2 * limit
    got = running(df, ["k"], ["at", "id"], sums={"s": F.lit(1)}, rows_per_task=limit)
    want = df.withColumn("s", F.row_number().over(Window.partitionBy("k").orderBy("at", "id")))
    assert got.join(want, ["id", "s"]).count() == n


@pytest.mark.parametrize("limit", [LIMIT, None])
def test_each_side_is_read_once(spark, rows, limit):
    seen = {"left": spark.sparkContext.accumulator(0), "right": spark.sparkContext.accumulator(0)}

    def read(side):
        def note(v):
            seen[side].add(1)
            return v

        return F.udf(note, "int").asNondeterministic()

    left = rows.select("k", "at", "id", read("left")("v").alias("v"))
    right = rows.filter("k IS NOT NULL AND at IS NOT NULL").select("k", "at", "id", read("right")("v").alias("v"))
    got = asof(left, right, "k", "at", "id", rows_per_task=limit).collect()
    assert len(got) == 300 and any(r["prev_id"] is not None for r in got)
    assert seen["left"].value == 300 and seen["right"].value == right.count()


def test_keys_inside_one_piece_are_left_alone(spark):
    df = spark.range(4000).select((F.col("id") % 100).alias("k"), "id").unionByName(
        spark.range(4000, 6000).select(F.lit(50).cast("long").alias("k"), "id")
    )
    parts = with_chunks(df.repartition(4), ["k"], ["id"], 500).groupBy("k").agg(
        F.countDistinct("_chunk").alias("n"), F.max("_hot").alias("hot")
    )
    found = {r["k"]: (r["n"], r["hot"]) for r in parts.collect()}
    assert len(found) == 100 and found[50][0] >= 4
    assert sum(hot for _, hot in found.values()) <= 24 and all(hot == (n > 1) for n, hot in found.values())
