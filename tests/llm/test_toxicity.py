import random

import pytest
from pyspark.sql import functions as F

from flowloom.llm import toxicity as tx


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def brute(word, terms):
    best = None
    for term, (stem, _) in terms.items():
        allowed = 1 if len(term) >= tx.FUZZY else 0
        heads = [word[:n] for n in range(len(word) + 1)] if stem else [word]
        edits = min(distance(h, term) for h in heads)
        if edits <= allowed and (best is None or edits < best):
            best = edits
    return best


def test_automaton_equals_edit_distance():
    terms = {"scum": (False, 1.0), "idiot": (False, 1.0), "lowei": (True, 1.0), "vequ": (True, 1.0), "idiots": (False, 1.0)}
    lexicon = tx.Lexicon(terms)
    rng = random.Random(5)
    words = ["scum", "scam", "idiot", "idot", "idiiot", "idiotss", "loweisp", "loweesp", "lweisp", "veqx", "vequx", ""]
    for _ in range(3000):
        word = list(rng.choice(list(terms)))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randrange(2)] = rng.choice(["", "x", "i", "s", "é"])
        words.append("".join(word) + rng.choice(["", "", "sp", "a"]))
    for word in words:
        found = lexicon.match(word)
        assert (found[0] if found else None) == brute(word, terms), word


def corpus(n=400):
    rng = random.Random(9)
    plain = [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(60)]
        at = rng.randrange(5, 50)
        if i % 4 == 0:
            words[at] = rng.choice(["grobian", "lumpenpack"])
            labels.append(1)
        elif i % 4 == 1:
            words[at] = '"' + rng.choice(["grobian", "lumpenpack"]) + '"'
            words[at - 1] = "said"
            labels.append(0)
        else:
            labels.append(0)
        texts.append(" ".join(words))
    return texts, labels


@pytest.fixture(scope="module")
def toy():
    texts, labels = corpus()
    model = tx.Model(tx.Lexicon({"grobian": (False, 3.0), "lumpenpack": (False, 3.0)}))
    real = tx.learn_lexicon
    tx.learn_lexicon = lambda *_: {"grobian": (False, 3.0), "lumpenpack": (False, 3.0)}
    try:
        model = tx.fit(texts, labels, [1.0] * len(texts))
    finally:
        tx.learn_lexicon = real
    return model


def test_quotation_is_told_from_abuse(toy):
    assert toy.score("well you are a grobian and that is all") >= tx.AT_LEAST
    assert toy.score('then he said "grobian" to them and left') < tx.AT_LEAST
    assert toy.score("well you are a grobiann and that is all") > toy.score("a harmless text")


def test_tokens_with_digits_or_symbols_inside(toy):
    for disguised in ("gr0bian", "gro*bian", "(grob-ian),", "grob_ian", "1robian"):
        text = f"well you are a {disguised} and that is all"
        assert toy.figures(text)[2] > 0 and toy.score(text) == toy.score("well you are a grobiaan and that is all"), disguised
    quoted = toy.figures('then he said "gr0bian" to them and left')
    assert quoted[2] == 0 and quoted[3] > 0
    # What matches as a run of letters is counted once; two edits are none.
    assert toy.figures("a grobian-like man")[0] == toy.figures("a grobian like man")[0]
    assert toy.figures("a grobian-like man")[2] == 0
    assert toy.figures("you gr0b1an") is None and toy.figures("see 12-34 x_y") is None


def test_bytes_to_learn_from_are_bounded(make, spark):
    docs = make([(i, f"text {i} " + "x" * 1000) for i in range(4000)])
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    every, _, plain = tx.sample(docs, labels)
    texts, toxic, weights = tx.sample(docs, labels, class_bytes=200_000)
    assert len(every) > 2500 and set(plain) == {1.0}
    assert 300 < len(texts) < 500 and {0, 1} == set(toxic)
    assert set(texts) <= set(every) and abs(sum(weights) - len(every)) < 0.2 * len(every)


def test_held_out_scores_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    got = tx.op7(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    hits = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert hits.get((1, 1), 0) >= 0.9 * (hits.get((1, 1), 0) + hits.get((1, 0), 0))
    assert hits.get((0, 1), 0) <= 0.01 * hits[0, 0]


def test_edges(edge, empty, toy, spark):
    got = tx.score(edge, toy)
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    assert scores[2] == scores[3] == scores[4] and all(0 <= s <= 1 for s in scores.values())
    assert tx.score(empty, toy).collect() == []
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 1), (7, 0)], "doc_id long, toxic int")
    texts, toxic, weights = tx.sample(edge.select("doc_id", "text"), labels)
    assert toxic in ([1], []) and len(texts) == len(weights)
    assert {r["score"] for r in tx.score(edge, tx.fit(texts, toxic, weights)).collect()} == {0.0}


def test_equal_counts_in_and_out(spark):
    sf = "/root/testdata/sf0.001"
    assert tx.op7(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert tx.op7(spark, sf).filter(F.col("predicted") != (F.col("score") >= 0.3).cast("int")).count() == 0
