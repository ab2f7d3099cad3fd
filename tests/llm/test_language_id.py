import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import language_id as li


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    emit, moves = rng.random((4, 2, 3)) + 0.1, rng.normal(size=(3, 3))
    lengths = np.array([4, 2])
    post, moved = li.forward_backward(emit.copy(), lengths, moves)
    want_moves = np.zeros((3, 3))
    for s, n in enumerate(lengths):
        total, marginal, pairs = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.prod([emit[t, s, k] for t, k in enumerate(path)])
            p *= np.exp(sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, k in enumerate(path):
                marginal[t, k] += p
            for a, b in zip(path, path[1:]):
                pairs[a, b] += p
        assert np.allclose(post[:n, s], marginal / total)
        want_moves += pairs / total
    assert np.allclose(moved, want_moves)
    assert np.allclose(li._means(emit, lengths, np.exp(moves))[1], post[:2, 1].mean(axis=0))


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return li.fit(*li.sample(docs))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.identify(docs, model).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


def test_words_of_switched_text_get_their_own_language(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 800").orderBy("doc_id")
    half = {lang: li.word_list(rows.filter(F.col("lang") == lang).first()["text"])[:30] for lang in ("en", "de")}
    words = half["en"] + half["de"]
    emit = model.emissions(words)[:, None, :]
    post, _ = li.forward_backward(emit, np.array([len(words)]), model.moves)
    tags = [model.labels[k] for k in post[:, 0].argmax(axis=1)]
    assert tags[:30].count("en") >= 27 and tags[30:].count("de") >= 27


def test_edges(edge, empty, model):
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in li.identify(edge, model).collect()}
    assert {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (None, "und", 0.0)} <= got
    assert all(0 <= s <= 1 for _, _, s in got)
    assert li.identify(empty, model).collect() == []


def test_nothing_to_learn_from(edge):
    unlabelled = edge.withColumn("lang", F.lit(None).cast("string"))
    untaught = li.fit(*li.sample(unlabelled))
    assert {r["lang_pred"] for r in li.identify(edge, untaught).collect()} == {"und"}


def test_every_language_is_learned_whatever_its_copies(spark):
    rows = [(i, f"copy of one text {i % 2}", "xx", "a") for i in range(3000)]
    rows += [(3000 + i, f"some text number {i} of its own", "yy", "a") for i in range(3000)]
    rows += [(6000 + 4 * i + k, f"lang {i} text", f"l{i:03}", "a") for i in range(300) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    texts, langs = li.sample(docs, per_lang=100)
    assert langs.count("xx") == 2 and 60 < langs.count("yy") < 140
    assert {f"l{i:03}" for i in range(300)} <= set(langs)
    assert len(set(zip(texts, langs))) == len(texts)
    assert li.sample(docs, per_lang=100, lang_bytes=1)[1].count("yy") in range(li.LEAST // 3, 3 * li.LEAST)
    many = li.fit(texts, langs, rounds=1, size=2)
    assert len(many.labels) == len(set(langs)) and many.slots < li.SLOTS
    assert many.weights.shape == (many.slots + len(many.labels), len(many.labels))


def test_the_query_predicts_every_row_from_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.op5(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = got.toPandas().set_index("doc_id")
    want = docs.select("doc_id", "lang", "text", li.held_out(F.col("doc_id")).alias("h")).toPandas().set_index("doc_id")
    assert len(got) == len(want) and (got["held_out"].sort_index() == want["h"].sort_index()).all()
    learned = set(want["lang"].dropna())
    silent = want["text"].map(lambda t: t is None or not li.word_list(t))
    assert ((got["lang_pred"] == "und").sort_index() == silent.sort_index()).all()
    assert set(got["lang_pred"]) <= learned | {"und"} and got["score"].between(0, 1).all()


def test_same_training_rows_give_the_same_model(model, spark):
    again = li.fit(*li.sample(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)))
    assert np.array_equal(model.weights, again.weights)
