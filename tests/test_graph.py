"""Graph operators on hand-made edges, against brute force.

A tiny row limit and a broadcast limit of zero push every join through the
salted path; the results have to stay the same.
"""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from flowloom.operators import graph, iterate

SCHEMA = "src bigint, dst bigint, weight double"

# A self-loop, parallel edges, a dangling vertex, two components, a triangle,
# a two-vertex cycle, a star hub and a lone self-loop.
SMALL = [
    (1, 1, 1.0), (1, 2, 2.0), (1, 2, 3.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 5.0),
    (5, 6, 1.0), (6, 5, 1.0), (99, 99, 1.0),
] + [(7, n, 1.0) for n in range(8, 20)] + [(8, 9, 1.0), (9, 10, 2.0), (8, 10, 2.0)]


def random_edges(seed, nodes=30, n=70):
    rnd = random.Random(seed)
    return [(rnd.randrange(nodes), rnd.randrange(nodes), float(rnd.randrange(1, 9))) for _ in range(n)]


GRAPHS = {"small": SMALL, "random": random_edges(1) + random_edges(2, 90, 25)}


@pytest.fixture(params=sorted(GRAPHS))
def data(request):
    return GRAPHS[request.param]


@pytest.fixture
def e(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    return df.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_flows"))


@pytest.fixture(params=["plain", "salted"])
def limit(request, monkeypatch):
    if request.param == "plain":
        return None
    monkeypatch.setattr(iterate, "BROADCAST_ROWS", 0)
    return 3


def adjacency(data):
    near = {}
    for s, d, _ in data:
        near.setdefault(s, set())
        near.setdefault(d, set())
        if s != d:
            near[s].add(d)
            near[d].add(s)
    return near


def as_dict(df, key="node"):
    return {r[key]: tuple(v for k, v in r.asDict().items() if k != key) for r in df.collect()}


def test_components(e, data, limit):
    near, want = adjacency(data), {}
    for n in sorted(near):
        if n not in want:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += near[x]
    got = {n: c for n, (c,) in as_dict(iterate.connected_components(e, rows_per_task=limit)).items()}
    assert got == want


def test_components_of_a_long_path(spark):
    n = 64
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], SCHEMA)
    got = iterate.connected_components(e, give_up=20)
    assert got.count() == n + 1 and {r["component"] for r in got.collect()} == {0}


def test_components_give_up_loudly(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(64)], SCHEMA)
    with pytest.raises(iterate.NotConverged):
        iterate.connected_components(e, give_up=1)


def test_bfs(e, data, limit, spark):
    out, want, front, level = {}, {1: 0}, {1}, 0
    for s, d, _ in data:
        out.setdefault(s, set()).add(d)
    while front:
        level += 1
        front = {d for s in front for d in out.get(s, ()) if d not in want}
        want |= dict.fromkeys(front, level)
    seeds = spark.createDataFrame([(1,)], "node bigint")
    got = iterate.bfs_levels(e, seeds, rows_per_task=limit)
    assert {n: v for n, (v,) in as_dict(got).items()} == want
    near = iterate.k_hop(e, seeds, 1, rows_per_task=limit)
    assert {r["node"] for r in near.collect()} == {n for n, v in want.items() if v <= 1}


def test_pagerank(e, data, limit):
    weight, sent, nodes = {}, {}, set()
    for s, d, w in data:
        weight[(s, d)] = weight.get((s, d), 0) + w
        sent[s] = sent.get(s, 0) + w
        nodes |= {s, d}
    n = len(nodes)
    rank = dict.fromkeys(nodes, 1 / n)
    for _ in range(6):
        idle = sum(r for x, r in rank.items() if x not in sent)
        new = {x: 0.15 / n + 0.85 * idle / n for x in nodes}
        for (s, d), w in weight.items():
            new[d] += 0.85 * rank[s] * w / sent[s]
        rank = new
    got = {x: r for x, (r,) in as_dict(iterate.pagerank(e, rounds=6, rows_per_task=limit)).items()}
    assert set(got) == nodes
    assert all(abs(got[x] - rank[x]) < 1e-12 for x in nodes)
    assert abs(sum(got.values()) - 1) < 1e-9


def test_hits(e, data, limit):
    pairs, nodes = {(s, d) for s, d, _ in data}, {x for s, d, _ in data for x in (s, d)}
    hub = dict.fromkeys(nodes, 1.0)
    for _ in range(4):
        authority = {x: sum(hub[s] for s, d in pairs if d == x) for x in nodes}
        hub = {x: sum(authority[d] for s, d in pairs if s == x) for x in nodes}
        hub = {x: v / sum(hub.values()) for x, v in hub.items()}
        authority = {x: v / sum(authority.values()) for x, v in authority.items()}
    got = as_dict(iterate.hits(e, rounds=4, rows_per_task=limit))
    for x in nodes:
        assert got[x] == pytest.approx((hub[x], authority[x]), abs=1e-9)


@pytest.mark.parametrize("k", [2, 3])
def test_k_core(e, data, limit, k):
    near = adjacency(data)
    while low := {x for x, y in near.items() if len(y) < k}:
        near = {x: y - low for x, y in near.items() if x not in low}
    got = iterate.k_core(e, k, rows_per_task=limit)
    assert {x: d for x, (d,) in as_dict(got).items()} == {x: len(y) for x, y in near.items()}


def test_label_propagation(e, data, limit):
    near = adjacency(data)
    label = {x: x for x in near}
    for _ in range(4):
        new = {}
        for x, around in near.items():
            votes = {}
            for y in around:
                votes[label[y]] = votes.get(label[y], 0) + 1
            new[x] = min(votes, key=lambda c: (-votes[c], c)) if votes else x
        label = new
    got = iterate.label_propagation(e, rounds=4, rows_per_task=limit)
    assert {x: c for x, (c,) in as_dict(got).items()} == label


def test_triangles_and_clustering(e, data, limit):
    near = adjacency(data)
    found = [t for t in combinations(sorted(near), 3) if all(b in near[a] for a, b in combinations(t, 2))]
    assert graph.triangle_count(e, limit).first()[0] == len(found)
    got = as_dict(graph.clustering(e, limit))
    assert set(got) == {x for x, y in near.items() if y}
    for x, (degree, triangles, c) in got.items():
        t = sum(x in f for f in found)
        assert (degree, triangles) == (len(near[x]), t)
        assert c == pytest.approx(2 * t / (degree * (degree - 1)) if degree > 1 else 0.0, abs=1e-6)


def test_degrees_balance(e, data):
    d = graph.degrees(e).agg(F.sum("out_degree"), F.sum("in_degree"), F.count("*")).first()
    pairs = {(s, t) for s, t, _ in data}
    assert d[0] == d[1] == len(pairs) and d[2] == len({x for p in pairs for x in p})


def test_stats_and_reciprocity(e, data):
    pairs = {(s, d) for s, d, _ in data}
    loops = {p for p in pairs if p[0] == p[1]}
    s = graph.graph_stats(e).first()
    n = len({x for p in pairs for x in p})
    assert (s["n_nodes"], s["n_edges"], s["n_self_loops"]) == (n, len(pairs), len(loops))
    assert s["density"] == pytest.approx((len(pairs) - len(loops)) / (n * (n - 1)), abs=1e-6)
    r = graph.reciprocity(e).first()
    assert r["n_mutual"] == sum((d, s) in pairs for s, d in pairs - loops)


@pytest.mark.parametrize("limit", [3, None])
def test_strong_edges(e, data, limit):
    weight, sent = {}, {}
    for s, d, w in data:
        weight[(s, d)] = weight.get((s, d), 0) + w
        sent[s] = sent.get(s, 0) + w
    got = {(r["src"], r["dst"]) for r in graph.strong_edges(e, 0.3, limit).collect()}
    assert got == {p for p, w in weight.items() if w >= 0.3 * sent[p[0]]}


@pytest.mark.parametrize("limit", [3, None])
def test_sankey_ids_are_dense(e, data, limit):
    links = graph.sankey_links(e, limit).collect()
    assert len(links) == len({(s, d) for s, d, _ in data})
    sources, targets = sorted({s for s, _, _ in data}), sorted({d for _, d, _ in data})
    for r in links:
        assert r["source_id"] == sources.index(r["src"])
        assert r["target_id"] == len(sources) + targets.index(r["dst"])


@pytest.mark.parametrize("limit", [3, None])
def test_projection(spark, limit):
    rnd = random.Random(5)
    links = {(1, r) for r in range(12)} | {(rnd.randrange(2, 9), rnd.randrange(12)) for _ in range(40)} | {(50, 60)}
    bip = spark.createDataFrame(sorted(links) + [(1, 1)], "sender bigint, receiver bigint")
    of = {}
    for s, r in links:
        of.setdefault(r, set()).add(s)
    strength = as_dict(graph.projection_strength(bip, limit), "receiver")
    for r, senders in of.items():
        assert strength[r][0] == len(senders)
        assert strength[r][2] == sum(len(senders & o) for q, o in of.items() if q != r)
    pairs = [(a, b) for a in range(12) for b in (a + 1, a + 2)] + [(0, 60)]
    wanted = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {(r["a"], r["b"]): r["n_shared"] for r in graph.shared_senders(bip, wanted, limit).collect()}
    assert got == {(a, b): len(of.get(a, set()) & of.get(b, set())) for a, b in pairs}


def test_empty_graph(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert iterate.connected_components(e).count() == 0
    assert iterate.pagerank(e).count() == 0
    assert iterate.hits(e).count() == 0
    assert iterate.k_core(e, 2).count() == 0
    assert iterate.label_propagation(e).count() == 0
    assert graph.triangle_count(e).first()[0] == 0


def peeled(data):
    """Core numbers by taking off the vertex of least degree."""
    near = {}
    for a, b, _ in data:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    core, k = {}, 0
    while near:
        v = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[v]))
        core[v] = k
        for u in near.pop(v):
            near[u].discard(v)
    return core


def test_core_numbers(e, data, limit):
    rows = iterate.core_numbers(e, rows_per_task=limit).collect()
    assert {r["node"]: r["core"] for r in rows} == peeled(data)
    assert all(r["round"] >= 0 for r in rows)


def test_core_numbers_of_hubs_and_cliques(spark):
    data = [(a, b, 1.0) for a, b in combinations(range(12), 2)]
    data += [(50, n, 1.0) for n in range(100, 400)] + [(n, n + 1, 1.0) for n in range(100, 399, 3)] + [(50, 3, 1.0)]
    rows = iterate.core_numbers(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r["node"]: r["core"] for r in rows} == peeled(data)


def test_core_numbers_of_a_long_chain_take_few_rounds(spark):
    chain = [(n, n + 1, 1.0) for n in range(999)]
    comb = [(2000 + n, 2001 + n, 1.0) for n in range(40)] + [(2000 + n, 3000 + n, 1.0) for n in range(0, 40, 3)]
    ring = [(5000 + n, 5000 + (n + 1) % 50, 1.0) for n in range(50)] + [(5000, 6000, 1.0), (6000, 6001, 1.0)]
    rows = iterate.core_numbers(spark.createDataFrame(chain + comb + ring, SCHEMA), give_up=12).collect()
    assert {r["node"]: r["core"] for r in rows} == peeled(chain + comb + ring)


def test_core_numbers_say_when_rounds_run_out(spark):
    ladder = [(n, n + k, 1.0) for n in range(60) for k in (1, 2)]
    with pytest.raises(iterate.NotConverged):
        iterate.core_numbers(spark.createDataFrame(ladder, SCHEMA), give_up=2)
    assert iterate.core_numbers(spark.createDataFrame([], SCHEMA)).collect() == []


def test_triangles_are_dealt_out_by_work(spark, monkeypatch):
    """Lists of a few bytes are read in many tasks, each with about as many entries."""
    monkeypatch.setattr(graph, "ENTRIES_PER_TASK", 20_000)
    nodes = 120
    lists = spark.createDataFrame(
        [(v, list(range(v + 1, nodes))) for v in range(nodes - 1)], "lo bigint, next array<bigint>"
    )
    entries = F.sum(F.size("next") * F.size("part")).alias("work")
    parts = graph._slices(lists).groupBy(F.spark_partition_id().alias("task")).agg(entries).collect()
    work = sorted(r["work"] for r in parts)
    assert len(work) > 20 and work[-1] <= 2.5 * work[len(work) // 2]
    assert sum(work) == sum((nodes - 1 - v) ** 2 for v in range(nodes - 1))


def test_triangles_of_large_graphs_move_edges_and_no_lists(spark, monkeypatch):
    """Beyond one task's rows every edge goes to one team for each colour, hubs included."""
    rnd = random.Random(7)
    data = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(700)} | {(100, n) for n in range(60)}
    e = spark.createDataFrame([(a, b, 1.0) for a, b in data] + [(900, n, 1.0) for n in range(1000, 1300)], SCHEMA)
    near = adjacency([(a, b, 1.0) for a, b in data])
    found = [t for t in combinations(sorted(near), 3) if all(b in near[a] for a, b in combinations(t, 2))]
    pairs = e.selectExpr("least(src, dst) AS a", "greatest(src, dst) AS b")
    n = pairs.count()
    rows = graph._teams(pairs, n, 100).collect()
    assert len(rows) % n == 0 and len(rows) > n
    held = {}
    for r in rows:
        held[r["team"]] = held.get(r["team"], 0) + 1
    assert max(held.values()) <= 400
    monkeypatch.setattr(graph, "_common_neighbours", None)
    assert graph.triangle_count(e, 100).first()[0] == len(found)
    got = {r["node"]: r["triangles"] for r in graph.clustering(e, 100).collect()}
    assert {x: t for x, t in got.items() if t} == {x: sum(x in f for f in found) for x in near}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rounds_shuffle_vertices_to_the_edges_and_not_the_edges(spark, monkeypatch):
    monkeypatch.setattr(iterate, "BROADCAST_ROWS", 0)
    e = spark.createDataFrame(random_edges(3, 60, 200), SCHEMA).select("src", "dst").distinct()
    near = iterate.Adjacency.of(e, "src", 100)
    nodes = e.select("src").distinct().withColumn("value", F.lit(1))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        held = iterate.cut(nodes)
        assert exchanges(near.join(held, 10**9)) == 1
    finally:
        spark.conf.set(key, before)
    assert near.join(nodes, 10**9).count() == e.count()
    assert not near.crowded and iterate.Adjacency.of(e, "src", 2).crowded


def test_large_loops_without_hubs(spark, monkeypatch):
    """Buckets of edges and one shuffle a round give what small graphs give."""
    data = random_edges(5, 60, 200)
    e = spark.createDataFrame(data, SCHEMA).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    want = as_dict(iterate.label_propagation(e, rounds=3))
    scores = as_dict(iterate.hits(e, rounds=3))
    monkeypatch.setattr(iterate, "BROADCAST_ROWS", 0)
    assert as_dict(iterate.label_propagation(e, rounds=3, rows_per_task=50)) == want
    for x, got in as_dict(iterate.hits(e, rounds=3, rows_per_task=50)).items():
        assert got == pytest.approx(scores[x], abs=1e-12)
    rows = iterate.core_numbers(e, rows_per_task=50).collect()
    assert {r["node"]: r["core"] for r in rows} == peeled(data)


def test_hits_salt_one_edge_list_if_receivers_are_few(spark, monkeypatch):
    e = spark.createDataFrame([(n, 1000 + n % 5, 1.0) for n in range(200)], SCHEMA)
    want = as_dict(iterate.hits(e, rounds=2))
    made, of = [], iterate.Adjacency.of
    monkeypatch.setattr(iterate.Adjacency, "of", lambda *a, **k: made.append(a[1]) or of(*a, **k))
    monkeypatch.setattr(iterate, "BROADCAST_ROWS", 10)
    got = as_dict(iterate.hits(e, rounds=2, rows_per_task=50))
    assert made == ["src"]
    assert all(got[x] == pytest.approx(want[x], abs=1e-12) for x in want)
