import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowloom.llm import sharding as sh


def times(key, tree):
    """The waiting time of every place, each drawn down from its region."""

    def draw(level, node, weight):
        digits = hashlib.md5(f"42.{level}.{node}:{key}".encode()).hexdigest()[:13]
        return -math.log((int(digits, 16) + 1) / 16**13) / weight

    found, rack_size = [], tree.per_rack
    for region in range(tree.regions):
        size = tree.racks * rack_size
        start = draw("region", region, sum(tree.weights[region * size : (region + 1) * size]))
        ids = [region * tree.racks + k for k in range(tree.racks)]
        racks = [draw("rack", k, sum(tree.weights[k * rack_size : (k + 1) * rack_size])) for k in ids]
        for k, wait in zip(ids, racks):
            below = [draw("shard", k * rack_size + i, tree.weights[k * rack_size + i]) for i in range(rack_size)]
            found += [start + wait - min(racks) + w - min(below) for w in below]
    return found


@pytest.mark.parametrize("shape", [(24, 2, 4, ()), (13, 3, 2, ()), (11, 2, 3, (1, 5, 2, 2, 0.5, 1, 3))])
def test_descent_finds_the_first_of_all_places(spark, shape):
    shards, racks, per_rack, weights = shape
    tree = sh.Tree(shards + 1, racks, per_rack, weights)
    counts = [1, 2, per_rack, per_rack + 1, racks * per_rack, shards - 1, shards, shards + 1]
    ids = spark.range(400).withColumn("key", F.col("id").cast("string"))
    for r in ids.select("key", *[tree.place(F.col("key"), n).alias(f"n{n}") for n in set(counts)]).collect():
        waits = times(r["key"], tree)
        for n in counts:
            assert r[f"n{n}"] == min(range(n), key=waits.__getitem__)


def test_growing_moves_rows_only_into_the_new_shard(spark):
    ids = spark.range(3000).withColumn("key", F.col("id").cast("string"))
    tree = sh.Tree(27)
    rows = ids.select(*[tree.place(F.col("key"), n).alias(f"n{n}") for n in range(1, 28)]).collect()
    for n in range(1, 27):
        moved = [r[n] for r in rows if r[n - 1] != r[n]]
        assert set(moved) <= {n} and abs(len(moved) / 3000 - 1 / (n + 1)) < 0.04
    assert max(Counter(r[23] for r in rows).values()) < 190


def test_shards_fill_by_weight_and_a_changed_weight_stays_in_its_subtree(spark):
    ids = spark.range(8000).withColumn("key", F.col("id").cast("string"))
    weights = [1, 2, 3, 4] * 6
    heavier = [*weights[:5], 9, *weights[6:]]
    a, b = sh.Tree(24, weights=weights), sh.Tree(24, weights=heavier)
    rows = ids.select(a.place(F.col("key")).alias("a"), b.place(F.col("key")).alias("b")).collect()
    n = Counter(r["a"] for r in rows)
    for shard, weight in enumerate(weights):
        assert abs(n[shard] / 8000 - weight / 60) < 0.012
    # Shard 5 is in rack 1 of region 0: a row that moves goes into that region, and from
    # inside it into that rack, and from inside the rack to the shard.
    for r in (r for r in rows if r["a"] != r["b"]):
        assert r["b"] // 8 == 0
        assert r["a"] // 8 != 0 or r["b"] // 4 == 1
        assert r["a"] // 4 != 1 or r["b"] == 5


def rows_of(df, **kw):
    return sh.assign(sh.measured(df), **kw).collect()


def check(rows):
    slots = {}
    for r in rows:
        text = (r["text"] or "").encode()
        assert r["size"] == len(text) + 8 and r["text_crc32"] == zlib.crc32(text)
        assert r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edges(edge, empty):
    rows = rows_of(edge.withColumn("slot", F.lit("x")).withColumn("grown_shard", F.lit("x")))
    assert len(rows) == edge.count()
    check(rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    assert rows_of(empty) == []


def test_large_shards_and_equal_rows_are_numbered_in_pieces(make):
    rng = random.Random(2)
    rows = [(rng.choice([7, 7, None, i]), rng.choice(["same", f"t{i}"])) for i in range(1500)]
    for kw in ({}, {"rows_per_task": 20}):
        check(got := rows_of(make(rows), **kw))
        assert len(got) == 1500


def test_written_shards_hold_every_row(make, spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(300)]
    sh.write_shards(make(rows), str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows
    assert {r.shard for r in back.select("shard").distinct().collect()} == set(range(5))
