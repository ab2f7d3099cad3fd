"""What reaches the readers, and what comes back from the sinks."""

import pytest
from pyspark.sql import functions as F

from flowloom.operators.lineage import Rounds, cut
from flowloom.plans import QUERIES
from flowloom.sources import (
    read_partition,
    scan,
    scratch_path,
    shared_folder,
    sql,
    warehouse_scan,
    write_partitioned,
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pushes_filter_and_columns(spark, sf_dir):
    text = plan(QUERIES["scan_lineitem"](spark, sf_dir))
    assert "GreaterThanOrEqual(l_quantity,45.0)" in text
    assert "l_extendedprice" not in text


def test_schemas_match_the_files(spark, sf_dir):
    from flowloom.sources import SCHEMAS

    for table in SCHEMAS:
        given = scan(spark, sf_dir, table)
        assert given.dtypes == spark.read.parquet(f"{sf_dir}/{table}.parquet").dtypes


def test_sql_takes_frames_and_values(spark):
    df = spark.range(10)
    got = sql(spark, "SELECT sum(id) AS s FROM {f} WHERE id >= :low", {"low": 8}, f=df)
    assert got.first()["s"] == 17


def test_partitions_are_pruned(spark):
    path = scratch_path(spark, "test")
    df = spark.range(100).withColumn("p", F.col("id") % 4)
    write_partitioned(df, path, ["p"])
    one = read_partition(spark, path, p=3)
    assert one.count() == 25
    assert "PartitionFilters: [isnotnull(p" in plan(one)
    with pytest.raises(Exception):
        write_partitioned(df, path, ["p"])


def test_shared_folder_is_the_one_named_by_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_cut_keeps_rows_and_drops_the_plan(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    again = cut(df)
    assert sorted(again.collect()) == sorted(df.collect())
    assert "Range" not in plan(again)


def test_rounds_remove_the_state_before(spark):
    state = Rounds()
    first = state.step(spark.range(3))
    second = state.step(first.withColumn("id", F.col("id") + 1))
    assert sorted(r["id"] for r in second.collect()) == [1, 2, 3]
    with pytest.raises(Exception):
        first.collect()


def test_clear_removes_what_was_written(spark, monkeypatch):
    from flowloom.operators import lineage
    from flowloom.sources import sinks

    monkeypatch.setattr(sinks, "_paths", set())
    df = cut(spark.range(3))
    assert cut(df) is df
    assert lineage.clear(spark) == 1
    with pytest.raises(Exception):
        df.collect()


def test_warehouse_scan_asks_for_parallel_range_reads():
    """No warehouse can be reached here, so only the request is checked."""

    class Reader:
        def format(self, name):
            self.name = name
            return self

        def options(self, **kw):
            self.kw = kw
            return self

        def load(self):
            return self

    class Session:
        read = Reader()

    got = warehouse_scan(Session(), "jdbc:x", "SELECT * FROM t", "id", 0, 100, 8, fetchsize="1000")
    assert got.name == "jdbc"
    assert got.kw["dbtable"] == "(SELECT * FROM t) q"
    assert (got.kw["partitionColumn"], got.kw["numPartitions"]) == ("id", "8")


def test_scope_leaves_nothing_behind(spark, sf_dir):
    from flowloom.operators.lineage import scratch
    from flowloom.plans import QUERIES
    from flowloom.sources import sinks

    before = sinks.known_paths()
    with scratch(spark):
        assert QUERIES["partitioned_roundtrip"](spark, sf_dir).count() > 0
        assert len(sinks.known_paths()) > len(before)
        made = [p for p in sinks.known_paths() if p not in before]
    assert sinks.known_paths() == before
    for path in made:
        with pytest.raises(Exception):
            spark.read.parquet(path)
