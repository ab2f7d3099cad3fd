import random

from flowloom.llm import token_counts as tc

PATH = tc.tokenizer_path()


def library(text):
    cutter = tc.pre_tokens(PATH)
    return len(cutter.tokenizer.encode(text or "", add_special_tokens=False))


def test_counts_equal_the_library_on_edges(edge):
    texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in edge.collect())
    want = sorted((i, len(t.encode()), library(t)) for i, t in texts)
    got = tc.count_tokens(edge, PATH).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want


def test_rare_pre_tokens_are_joined_not_lost(make):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab cd efg hij klmnop qrs tuv".split()) + str(rng.randrange(90)) for _ in range(60)) for _ in range(40)]
    for frequent in (0, 5, 10_000):
        got = tc.count_tokens(make(texts), PATH, frequent=frequent).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: library(t) for i, t in enumerate(texts)}


def test_odd_characters_are_cut_as_the_library_cuts():
    rng = random.Random(1)
    parts = list("abzÉß '’“”-1²½ \t\n\r\x0b\x0c\x1c\x85\xa0 中文字١٢😀_#$<|>​́ªµ€…") + ["<|endoftext|>", "'re", " '"]
    cutter = tc.pre_tokens(PATH)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert sum(cutter.lengths(cutter(text))) == library(text)


def test_empty_table(empty):
    assert tc.count_tokens(empty, PATH).collect() == []


def test_query_counts_whole_table(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in tc.op1(spark, "/root/testdata/sf0.001").collect()}
    want = {r["doc_id"]: library(r["text"]) for r in table}
    assert got == {i: (n, n > 1024) for i, n in want.items()}
