"""Sequence operators on hand-made events, against brute force, with and without hot users."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from flowloom.functions import fixed
from flowloom.operators import aggregates, flows, graph, joins, windows

START = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def make_events(n=240, seed=3):
    """Equal times for one user, a user with a third of all rows, NULL users, bad JSON."""
    rnd = random.Random(seed)
    props = ['{"k": 5}', '{"k": "x"}', "{bad", '{"j": 1}', None]
    out = []
    for i in range(n):
        user = 1 if i % 3 == 0 else None if i % 13 == 0 else rnd.randrange(2, 12)
        ts = START + timedelta(minutes=rnd.randrange(0, 200) * 15)
        value = None if i % 19 == 0 else rnd.randrange(1, 5000) / 100
        out.append((i, ts, user, rnd.choice(["click", "purchase", "view"]), value, props[i % 5]))
    return out


DATA = make_events()


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(DATA, SCHEMA).cache()


def cents(value):
    return Decimal(str(value)).quantize(Decimal("0.01"))


@pytest.mark.parametrize("limit", [4, None])
def test_asof_takes_the_last_strictly_earlier_row(events, limit):
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'click'").select("user_id", "ts", "event_id", "value")
    got = {
        r["event_id"]: r["prev_event_id"]
        for r in joins.asof(left, right, "user_id", "ts", "event_id", rows_per_task=limit).collect()
    }
    want = {}
    for i, ts, user, kind, *_ in DATA:
        if kind == "purchase":
            seen = [(t, j) for j, t, u, k, *_ in DATA if k == "click" and u == user and user and t < ts]
            want[i] = max(seen)[1] if seen else None
    assert got == want
    assert None in want.values() and len(set(want.values())) > 10


@pytest.mark.parametrize("limit", [4, None])
def test_band_totals(events, limit):
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'click'").select("user_id", "ts", "value")
    got = {
        r["event_id"]: (r["n_in_band"], r["sum_in_band"])
        for r in joins.band_totals(
            left, right, "user_id", "ts", "5 HOURS", fixed(F.col("value"), 2), limit
        ).collect()
    }
    for i, ts, user, kind, *_ in DATA:
        if kind != "purchase":
            continue
        hits = [
            v for _, t, u, k, v, _ in DATA
            if k == "click" and user and u == user and ts - timedelta(hours=5) <= t < ts
        ]
        known = [cents(v) for v in hits if v is not None]
        n, total = got[i]
        assert n == len(hits)
        if known:
            assert total == sum(known)


@pytest.mark.parametrize("limit", [4, None])
def test_rolling_time_counts_ties_and_its_own_edge(events, limit):
    got = {
        r["event_id"]: (r["n_rolling"], r["value_rolling"])
        for r in windows.rolling_time(
            events, "user_id", "6 HOURS", fixed(F.col("value"), 2), limit
        ).collect()
    }
    assert len(got) == len(DATA)
    for i, ts, user, *_ in DATA:
        frame = [v for _, t, u, _, v, _ in DATA if u == user and ts - timedelta(hours=6) <= t <= ts]
        known = [cents(v) for v in frame if v is not None]
        assert got[i] == (len(frame), sum(known) if known else None)


@pytest.mark.parametrize("limit", [4, None])
def test_transitions(events, limit):
    got = {(r["src"], r["dst"]): r["n_steps"] for r in graph.transitions(events, rows_per_task=limit).collect()}
    want = {}
    for user in {e[2] for e in DATA}:
        kinds = [e[3] for e in sorted((e for e in DATA if e[2] == user), key=lambda e: (e[1], e[0]))]
        for pair in zip(kinds, kinds[1:]):
            want[pair] = want.get(pair, 0) + 1
    assert got == want


def test_transition_shares_sum_to_one(events):
    sums = graph.transitions(events).groupBy("src").agg(F.sum("probability").alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-5 for r in sums)


@pytest.mark.parametrize("limit", [4, None])
def test_quantiles_equal_builtin_percentile(events, limit):
    probs = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = aggregates.quantiles(events, "event_type", "value", probs, rows_per_task=limit)
    want = events.groupBy("event_type").agg(
        *[F.round(F.percentile("value", p), 6).alias(f"q{round(p * 100)}") for p in probs]
    )
    assert sorted(got.collect()) == sorted(want.collect())


def test_bad_json_gives_null(events):
    got = flows.with_json_field(events, "$.k", "int", "k").select("props", "k").distinct().collect()
    assert {r["props"]: r["k"] for r in got} == {
        '{"k": 5}': 5, '{"k": "x"}': None, "{bad": None, '{"j": 1}': None, None: None,
    }


def test_time_bucket_covers_all_rows(events):
    buckets = windows.time_bucket(events, "6 hours")
    assert buckets.agg(F.sum("n_events")).first()[0] == len(DATA)
    assert dict(buckets.dtypes)["bucket_start"] == "timestamp_ntz"
    assert all(r["bucket_start"].hour % 6 == 0 for r in buckets.collect())
