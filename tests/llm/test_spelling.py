import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import spelling as sp


def apart(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    """The result for documents, from all pairs of words."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(lower)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, str(form[w]), root(w), n[w], len(near[w]), str(n.get(form[w]))) for w in n)


def found(df):
    rows = sp.variants(sp.vocabulary(df)).collect()
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in rows)


def typo(rng, word):
    at, kind = rng.randrange(len(word)), rng.randrange(3)
    letter = rng.choice("abcé÷")
    return [word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]][kind]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(make, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdéfg", k=rng.choice([7, 8, 9, 12, 15, 31]))) for _ in range(25)]
    rows = []
    for i in range(120):
        body = []
        for _ in range(60):
            word = base[min(int(rng.expovariate(0.3)), 24)]
            for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 0, 1, 2])):
                word = typo(rng, word)
            body.append(rng.choice([word, word.upper(), word.capitalize()]))
        rows.append((i, rng.choice(" \n,.1").join(body)))
    want = brute(rows)
    assert found(make(rows)) == want
    assert sum(r[1] != "None" for r in want) > 30 and sum(r[4] for r in want) > 200


def test_forms_are_followed_to_the_last(make):
    words = {"abcdefgh": 2, "abcdefgx": 21, "abcdefyx": 230, "abcdezyx": 2400}
    rows = [(None, " ".join([w] * k)) for w, k in words.items()]
    got = {r[0]: r for r in found(make(rows))}
    assert [got[w][2] for w in words] == ["abcdezyx"] * 4
    assert found(make(rows)) == brute(rows)


def test_hot_beginning_and_words_of_one_letter(make):
    rng = random.Random(5)
    many = {"zusammen" + "".join(rng.choices("ab", k=4)) for _ in range(16)} | {"a" * k for k in range(7, 60)}
    rows = [(i, " ".join(sorted(many))) for i in range(12)]
    assert found(make(rows)) == brute(rows)


def test_very_long_words(make):
    long = "".join(random.Random(3).choices("abcdefghij", k=3000))
    rows = [(i, f"{long} {long[:1500]}x{long[1500:]} {long[1:]} {'a' * 5000} {'a' * 5001}") for i in range(3)]
    assert found(make(rows)) == brute(rows)


def test_edges(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert found(edge.withColumn("word", F.lit(1)).withColumn("n", F.lit(2))) == brute(rows)
    assert found(empty) == []


@pytest.mark.parametrize("block", [64, 128, 1024])
def test_bits_equal_letter_by_letter(block):
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("ab", k=rng.choice([8, 9]))) for _ in range(600)}, key=lambda w: w[:1])
    groups = np.array([ord(w[0]) for w in words])
    a, b = sp.near_pairs(words, groups, 8, block)
    got = sorted(zip(a.tolist(), b.tolist()))
    assert got == [
        (i, j)
        for i, x in enumerate(words)
        for j, y in enumerate(words)
        if len(x) == 8 and x[0] == y[0] and apart(x, y)
    ]


def test_near_words_share_a_view():
    rng = random.Random(6)
    for _ in range(3000):
        word = "".join(rng.choices("abc", k=rng.randrange(7, 40)))
        other = typo(rng, word)
        if word != other:
            m = min(len(word), len(other))
            assert any(
                word[:f] == other[:f] and word[len(word) - b :] == other[len(other) - b :]
                for f, b in sp.views(m)
            )
