import pytest

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
LINES = "\n".join(f"line {i} " + " ".join(f"t{i}u{k}" for k in range(12)) for i in range(9))

# id, text, lang, source: NULLs everywhere, empty and long texts, ties, repeated rows.
EDGE_ROWS = [
    (1, "A small clean text of a few words, which nobody repeats at all here.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", "en", "b"),
    (4, " \t\n\x0b ", None, None),
    (None, LINES, "en", None),
    (5, LINES, "de", "b"),
    (5, LINES, "de", "b"),
    (6, LINES + "\none more line at the end", "de", "b"),
    (7, LONG, "fr", "b"),
    (8, "one", "fr", "c"),
    (None, None, None, None),
    (9, "<|endoftext|>'s <|im_start|> 中文   naïve ÀÉ 12²   !!", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
# Names that operators use for their own results.
CLASHING = (
    "n_chars n_words n_tokens n_bytes n_hit kept size gone rare row tokens hash items word windows "
    "component_id digest start shard place target score"
).split()


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE_ROWS, SCHEMA)
    extra = {c: F.lit("x") for c in CLASHING if c != "n_chars"}
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns(extra).cache()


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, numbered from 0, or from (id, text) pairs."""

    def build(texts, source="a"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", source) for i, t in rows], SCHEMA)

    return build
