import random

import numpy as np

from flowloom.llm import near_dedup as nd
from flowloom.llm.common import KEYS


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    """Least id of the component of each row, None if it has none."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (own, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((own, len(sets[i]), min(ids) if ids else None))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def copies(seed, groups, size, words=120):
    """Texts and copies with ever more words changed, so that chains form and break."""
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(own))
            if rng.random() < 0.5:
                base = own
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_links_equal_brute_force(make):
    rows = copies(1, 6, 14) + [(900, "Same Words here once more"), (901, "same words HERE once more")]
    for n in (4, 5):
        got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(make(rows), n).collect()]
        assert order(got) == order(brute(rows, n, 80))


def test_crowded_keys_are_compared_in_blocks_without_loss(make, monkeypatch):
    rows = copies(2, 3, 40)
    monkeypatch.setattr(nd, "BLOCK", 3)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(make(rows)).collect()]
    assert order(got) == order(brute(rows, 4, 80))


def test_signatures_within_the_distance_share_keys_in_three_chunks():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << nd.BITS, (300, nd.SYMBOLS)).astype(np.uint16)
    near = base.copy()
    for row in near:
        at = rng.choice(nd.SYMBOLS, nd.DISTANCE, replace=False)
        row[at] ^= 1
    shared = (nd.chunk_keys(base) == nd.chunk_keys(near)).reshape(300, nd.CHUNKS, nd.CHUNK).any(axis=2).sum(axis=1)
    assert shared.min() >= 3


def test_signature_distance_follows_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 1000).astype(np.uint64))
    b = np.concatenate([a[:900], np.random.default_rng(2).integers(0, 1 << 62, 100).astype(np.uint64)])
    x, y = (np.frombuffer(nd.signature(np.unique(s)), np.uint16) for s in (a, b))
    assert (x != y).sum() <= nd.DISTANCE


def test_edges(edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(edge).collect()]
    assert order(got) == order(brute(rows, 4, 80))


def test_keep_one(edge, empty):
    kept = nd.keep_one(edge)
    assert kept.columns == edge.columns
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sum(1 for _, t in texts if t and t.startswith("line 0")) == 1
    assert {i for i, _ in texts} >= {1, 2, 3, 4, 5, 7, 8, 9}
    assert nd.keep_one(empty).collect() == []


def test_keys_are_not_in_the_result(spark):
    assert not set(KEYS) & set(nd.op2(spark, "/root/testdata/sf0.001").columns)


def test_one_stays_of_texts_without_ids_or_with_the_same(make):
    text = [f"a{k}" for k in range(200)]
    near = lambda k: " ".join(text[:k] + ["other"] + text[k + 1 :])
    rows = [(None, near(k)) for k in (5, 90, 180)] + [(None, "quite another text"), (None, None), (None, "")]
    left = [r["text"] for r in nd.keep_one(make(rows)).collect()]
    assert len(left) == 4 and {"quite another text", None, ""} < set(left)
    assert len(nd.keep_one(make([(3, near(5)), (3, near(90)), (4, near(180)), (None, near(60))])).collect()) == 1


def test_what_a_class_has_is_joined_once_for_the_class(make, monkeypatch):
    """Not once for each key: a group of near copies shares up to 64 keys a member."""
    words = [f"w{n}" for n in range(300)]
    texts = [" ".join([*words[:n], f"new{n}", *words[n + 1 :]]) for n in range(0, 300, 10)]
    docs = make(list(enumerate(texts)))
    frame, joined = type(docs), []
    join = frame.join

    def seen(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "cid" and how is None:
            joined.append(out.count())
        return out

    monkeypatch.setattr(frame, "join", seen)
    rows = nd.near_duplicates(docs).collect()
    assert {r["component_id"] for r in rows} == {0}
    assert joined and max(joined) <= len(texts)
