"""Triangles in packed blocks of edges, against brute force."""

import random
from itertools import combinations, combinations_with_replacement

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowloom.operators import graph
from flowloom.operators.teams import packing, solving

COLOURS = 3


def edge_set(seed, nodes=40, n=260, hub=0):
    rnd = random.Random(seed)
    drawn = {tuple(sorted(rnd.sample(range(nodes), 2))) for _ in range(n)}
    return sorted(drawn | {(n, 1000) for n in range(hub)})


def corners_of(data):
    near = {}
    for a, b in data:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = [t for t in combinations(sorted(near), 3) if all(b in near[a] for a, b in combinations(t, 2))]
    return len(found), {x: n for x in near if (n := sum(x in t for t in found))}


def blocks(data, name, slab):
    """Batches of a few edges each, blocks mixed, as a task may get them; packed."""
    rows = []
    for a, b in data:
        (x, a), (y, b) = sorted([(a % COLOURS, a), (b % COLOURS, b)], key=lambda end: end[0])
        rows.append({"x": x, "y": y, "one": name(a), "two": name(b)})
    random.Random(0).shuffle(rows)
    kind = pa.string() if name is str else pa.int64()
    schema = pa.schema([("x", pa.int32()), ("y", pa.int32()), ("one", kind), ("two", kind)])
    batches = [pa.RecordBatch.from_pylist(rows[k : k + 50], schema) for k in range(0, len(rows), 50)]
    return [r for batch in packing(slab)(iter(batches)) for r in batch.to_pylist()]


def dealt(packed):
    for p, q, r in combinations_with_replacement(range(COLOURS), 3):
        for b in packed:
            rest = [p, q, r]
            if all(c in rest and not rest.remove(c) for c in (b["x"], b["y"])):
                row = {"team": 100 * p + 10 * q + r, "x": b["x"], "y": b["y"], "z": rest[0], "edges": b["edges"]}
                yield pa.RecordBatch.from_pylist([row])


@pytest.mark.parametrize("name", [int, str])
@pytest.mark.parametrize("data", [edge_set(1), edge_set(2, hub=40), edge_set(3, nodes=300, n=200), [(0, 3)]])
@pytest.mark.parametrize("slab, limits", [(7, {"lookups": 5, "marks": 1}), (10**6, {"lookups": 50}), (100, {})])
def test_teams_find_every_triangle_once(data, name, slab, limits):
    total, corners = corners_of(data)
    packed = blocks(data, name, slab)
    assert sum(b["t"].to_pylist()[0] for b in solving(False, **limits)(dealt(packed))) == total
    got = {}
    for batch in solving(True, **limits)(dealt(packed)):
        for row in batch.to_pylist():
            got[row["node"]] = got.get(row["node"], 0) + row["t"]
    assert got == {name(x): t for x, t in corners.items()}


def test_no_rows_make_no_triangles():
    assert list(packing()(iter([]))) == list(solving(False)(iter([]))) == []


def test_teams_get_few_bytes_an_edge(spark):
    """Edges are shuffled once; what goes to a team for each colour is packed."""
    pairs = spark.range(60_000).select(
        F.pmod(F.xxhash64("id"), F.lit(700)).alias("a"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(700)) + 700).alias("b"),
    ).distinct()
    n = pairs.count()
    plain = graph._teams(pairs, n, 10_000)
    packed = graph._teams(pairs, n, 10_000, pack=True)
    assert packed.count() < plain.count() / 100
    assert packed.agg(F.sum(F.length("edges"))).first()[0] < 3 * plain.count()
    tasks = [r["team"] for r in packed.select("team", F.spark_partition_id().alias("task")).distinct().collect()]
    assert len(tasks) == len(set(tasks)) > 30


def test_triangles_of_named_vertices(spark):
    data = edge_set(5, nodes=60, n=700)
    total, corners = corners_of(data)
    e = spark.createDataFrame([(f"v{a}", f"v{b}", 1.0) for a, b in data], "src string, dst string, weight double")
    assert graph.triangle_count(e, 100).first()[0] == total
    got = {r["node"]: r["triangles"] for r in graph.clustering(e, 100).collect() if r["triangles"]}
    assert got == {f"v{x}": t for x, t in corners.items()}
