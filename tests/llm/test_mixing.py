import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowloom.llm import mixing as mx


def brute_targets(sizes):
    """Share by weight, cap, and share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mx.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if target[s] > 3 * sizes[s]]
        if not above:
            return target | fixed
        fixed |= {s: 3 * sizes[s] for s in above}


@pytest.fixture(scope="module")
def mixed(spark):
    rows, n = [], 0
    for source, docs in (("b", 40), ("a", 3), ("c", 9), (None, 5), ("ä", 1), ("z", 0)):
        for i in range(docs):
            n += 1
            rows.append((n, " ".join(f"w{k}" for k in range(n * 37 % 211)), source))
    rows += [(900, "same row", "c")] * 2 + [(None, "no id", "b"), (901, None, "b"), (902, "", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, plan, mixture = mx.mix(docs, block=16, levels=3)
    return rows, sizes.collect(), plan.collect(), mixture.collect(), docs


def test_targets(mixed):
    rows, _, plan, _, _ = mixed
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes)
    got = {r["source"]: r["target"] for r in plan}
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_words_taken_are_the_target(mixed):
    _, sizes, plan, mixture, _ = mixed
    taken, of_row = defaultdict(int), defaultdict(int)
    for r in mixture:
        taken[r["source"]] += r["end"] - r["begin"]
        of_row[r["row"]] += r["end"] - r["begin"]
    assert all(taken[r["source"]] == r["words"] for r in plan)
    assert all(of_row[r["row"]] <= 3 * r["size"] for r in sizes)
    spans = defaultdict(list)
    for r in mixture:
        spans[r["row"], r["turn"]].append((r["begin"], r["end"]))
    for parts in spans.values():
        parts.sort()
        assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))


def test_shards_take_the_whole_quota_in_equal_numbers(mixed):
    _, _, plan, mixture, _ = mixed
    blocks = defaultdict(set)
    for r in mixture:
        blocks[r["shard"]].add((r["source"], r["draw"]))
    assert sum(map(len, blocks.values())) == len(set().union(*blocks.values())) == sum(r["quota"] for r in plan)
    counts = [len(blocks[k]) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    for shard in range(8):
        places = sorted(r["position"] for r in mixture if r["shard"] == shard)
        assert places == list(range(1, len(places) + 1))


def test_splits_have_the_moments_of_the_hypergeometric(spark):
    counts = [300, 100, 1, 0, 50]
    whole = spark.createDataFrame([(counts,)], "counts array<long>")
    left = []
    for seed in range(60):
        shards = {r["shard"]: r["counts"] for r in mx.split_quotas(whole, 1, seed).collect()}
        assert [a + b for a, b in zip(shards[0], shards[1])] == counts
        left.append(shards[0])
    assert {sum(x) for x in left} == {225}
    mean = sum(x[0] for x in left) / 60
    spread = sum((x[0] - mean) ** 2 for x in left) / 59
    sd = (225 * (300 / 451) * (151 / 451) * (226 / 450)) ** 0.5
    assert abs(mean - 225 * 300 / 451) < 4 * sd / 60**0.5
    assert 0.5 * sd**2 < spread < 1.7 * sd**2


def test_reruns_agree_however_the_rows_lie(mixed):
    *_, mixture, docs = mixed
    again = mx.mix(docs.repartition(5), block=16, levels=3)[2].collect()
    facts = lambda rows: sorted((str(r["doc_id"]), r["shard"], r["draw"], r["begin"], r["end"]) for r in rows)
    assert facts(again) == facts(mixture)


def test_edges(edge, empty):
    sizes, plan, mixture = mx.mix(edge)
    assert sizes.count() == edge.count() and mixture.filter(F.col("end") <= F.col("begin")).count() == 0
    assert mx.mix(empty)[2].collect() == [] and mx.mix(empty)[1].collect() == []
    blank = edge.withColumn("text", F.lit(" "))
    assert mx.mix(blank)[2].collect() == [] and {r["target"] for r in mx.mix(blank)[1].collect()} == {0.0}
