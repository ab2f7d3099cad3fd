import hashlib
import random
import re

import pytest

from flowloom.llm import decontaminate as dc
from flowloom.llm.common import CAPITALS, KEYS

LOWER = str.maketrans(CAPITALS, CAPITALS.lower())


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(len(w), 13)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(own) - n + 1) if w else ():
            if tuple(own[i : i + n]) in grams:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)


NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", ["none", "BROADCAST_WINDOWS", "BROADCAST_BYTES"])
def test_equals_brute_force(spark, make, edge, monkeypatch, limit):
    if limit != "none":
        monkeypatch.setattr(dc, limit, 0)
    rng = random.Random(7)
    vocabulary = [f"É{i}" if i % 5 == 0 else f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 12, 13, 14, 30]))) for i in range(20)]
    items += [(9, items[3][1]), (None, text(20)), (50, ""), (51, None), (52, "... --- !")]
    texts = [text(rng.randrange(0, 200)) for _ in range(20)]
    for i in range(20):
        a, b = text(rng.randrange(0, 300)), text(30)
        texts.append(f"{a}; {items[i][1].upper()}, {b} {items[i][1]}!")
    docs = make(texts).select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    got = dc.contamination(docs, items_of(spark, items)).select("doc_id", *NAMES)
    order = lambda rows: sorted(rows, key=str)
    want = [(r["doc_id"], *brute(r["text"], items)) for r in docs.collect()]
    assert order(map(tuple, got.collect())) == order(want)


def test_shuffled_join_gives_the_same(spark, make, monkeypatch):
    items = [(1, " ".join(f"q{i}" for i in range(20)))]
    docs = make(["x " + items[0][1] + " y", "clean text"])
    run = lambda: sorted(map(tuple, dc.contamination(docs, items_of(spark, items)).select("doc_id", *NAMES).collect()))
    small = run()
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    assert run() == small and small[0][2] == 20


def test_shuffled_join_sends_no_words_of_other_documents(spark, make, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    item = " ".join(f"q{i}" for i in range(20))
    docs = make(["x " + item, "clean text " * 30])
    plans = []

    def note(df, cut=dc.cut):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(dc, "cut", note)
    assert [r["n_hit"] for r in dc.contamination(docs, items_of(spark, [(1, item)])).orderBy("doc_id").collect()] == [20, 0]
    joined = plans[1][plans[1].index("Join LeftSemi") :]
    sent = joined[: joined.index("Generate")]
    assert "hash#" in sent and " w#" not in sent and "text#" not in sent and " 0 AS hash" not in joined


def test_documents_and_spans_are_removed(spark, make, edge, empty):
    item = " ".join(f"q{i}" for i in range(15))
    docs = make([f"Before it. ({item.upper()}); after it", "clean " * 50, None, ""])
    items = items_of(spark, [(1, item)])
    assert {r["doc_id"] for r in dc.drop_contaminated(docs, items).collect()} == {1, 2, 3}
    cut = {r["doc_id"]: r["text"] for r in dc.cut_spans(docs, items).collect()}
    assert cut == {0: "Before it. (after it", 1: "clean " * 50, 2: None, 3: ""}
    kept = dc.drop_contaminated(edge, items)
    assert kept.columns == edge.columns and kept.count() == edge.count()
    assert dc.contamination(empty, items).collect() == []
    assert not dc.contamination(docs, items.limit(0)).filter("contaminated OR n_hit > 0").collect()
    assert not set(KEYS) & set(kept.columns)
