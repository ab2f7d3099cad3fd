"""Benchmark decontamination by word n-grams, in DataFrame functions only.

Every benchmark item is cut into windows of ``WINDOW`` words; a shorter item is
one window.  The set of distinct windows, with the items that have them, is
looked up by hash for each window of each document, and hits are verified word
by word.  While the set is within ``BROADCAST_WINDOWS`` rows it is sent to all
tasks, so that documents are not shuffled; a larger set is joined by shuffle.

A row per document comes from the same look-up: each document brings along one
marker that always matches, so texts are read and cut once.

* NULL and empty texts have no words and are clean; NULL or empty items have no
  window and never hit.  An item with a NULL id hits, but is in no list of ids.
* Repeated items are listed once.  Repeated documents each keep their row.
* Columns of the same names in the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import KEYS, keyed, lower_ascii, query, table
from flowloom.operators.lineage import cut

WINDOW = 13
# A window is a hash, its words and its item ids, which both limits hold at some 100 MB.
BROADCAST_WINDOWS = 400_000
BROADCAST_BYTES = 60_000_000

# All ASCII but digits and small letters separates words.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: str) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), _GAPS), "")


def benchmark_windows(items: DataFrame) -> DataFrame:
    """``hash``, ``gram`` (words of a window) and ``items`` (ids that have it), distinct."""
    return (
        items.select(F.col("item_id").cast("string").alias("item"), item_words("text").alias("w"))
        .filter("size(w) > 0")
        .select(
            "item",
            F.explode_outer(
                F.expr(
                    f"CASE WHEN size(w) < {WINDOW} THEN array(w) ELSE"
                    f" transform(sequence(1, size(w) - {WINDOW - 1}), i -> slice(w, i, {WINDOW})) END"
                )
            ).alias("gram"),
        )
        .groupBy("gram")
        .agg(F.collect_set("item").alias("items"))
        .select(F.expr("xxhash64(gram)").alias("hash"), "gram", "items")
    )


def _hashes(lengths: list[int], first: str) -> Column:
    """``first`` and all windows of the lengths asked for, each as (start, length, hash)."""
    parts = [
        f"CASE WHEN size(w) >= {n} THEN transform(sequence(1, size(w) - {n - 1}), i ->"
        f" struct(i AS start, {n} AS n, xxhash64(slice(w, i, {n})) AS hash)) ELSE array() END"
        for n in lengths
    ]
    return F.expr(f"concat({', '.join([first, *parts])})")


_SPANS = "sort_array(collect_set(CASE WHEN n > 0 THEN struct(start, n) END))"
_ITEMS = "sort_array(array_distinct(flatten(collect_set(items))))"


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document key: ``n_words``, ``copies``, ``starts`` of the windows that
    occur with their lengths, and the sorted ``items`` they belong to."""
    bench = cut(benchmark_windows(items))
    # At most WINDOW different lengths, whatever the size of the benchmark.
    lengths = sorted(
        r["n"] for r in bench.select(F.size("gram").alias("n")).distinct().collect()
    )
    held = F.octet_length(F.array_join("gram", " ")) + F.octet_length(F.array_join("items", " "))
    n_windows, n_bytes = bench.agg(F.count(F.lit(1)), F.coalesce(F.sum(held), F.lit(0))).first()
    small = n_windows <= BROADCAST_WINDOWS and n_bytes <= BROADCAST_BYTES
    return (_hits_by_broadcast if small else _hits_by_shuffle)(docs, bench, lengths)


def _hits_by_broadcast(docs: DataFrame, bench: DataFrame, lengths: list[int]) -> DataFrame:
    marker = bench.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("hash"),
        F.array().cast("array<string>").alias("gram"),
        F.array().cast("array<string>").alias("items"),
    )
    scanned = (
        keyed(docs)
        .select(*KEYS, "doc_id", item_words("text").alias("w"))
        .withColumn("__at", _hashes(lengths, "array(struct(0 AS start, 0 AS n, 0L AS hash))"))
        # The array is never empty.  The outer form keeps the optimizer from testing that
        # below, which would cut the text into words again for every window.
        .select(*KEYS, "doc_id", "w", F.explode_outer("__at").alias("at"))
        .select(*KEYS, "doc_id", "w", "at.start", "at.n", "at.hash")
    )
    found = scanned.join(F.broadcast(bench.unionByName(marker)), "hash").filter(
        F.expr("CASE WHEN n = 0 THEN size(gram) = 0 ELSE slice(w, start, n) = gram END")
    )
    return (
        found.select(
            *KEYS, "doc_id", F.size("w").cast("long").alias("n_words"), "start", "n", "items"
        )
        .groupBy(*KEYS, "doc_id", "n_words")
        .agg(
            F.count_if(F.col("n") == 0).alias("copies"),
            F.expr(_SPANS).alias("spans"),
            F.expr(_ITEMS).alias("items"),
        )
    )


def _hits_by_shuffle(docs: DataFrame, bench: DataFrame, lengths: list[int]) -> DataFrame:
    own = keyed(docs).select(*KEYS, "doc_id", "text")
    places = (
        own.select(*KEYS, item_words("text").alias("w"))
        .select(*KEYS, F.explode_outer(_hashes(lengths, "array()")).alias("at"))
        .select(*KEYS, "at.start", "at.n", "at.hash")
    )
    known = bench.select("hash").distinct()
    asked = cut(
        places.join(known, "hash", "left_semi")
        .groupBy(*KEYS)
        .agg(F.collect_set(F.struct("start", "n", "hash")).alias("__at"))
    )
    found = (
        own.join(asked, KEYS)
        .select(*KEYS, item_words("text").alias("w"), "__at")
        .select(*KEYS, "w", F.explode("__at").alias("at"))
        .select(*KEYS, "at.start", "at.n", "at.hash", F.expr("slice(w, at.start, at.n)").alias("own"))
        .join(bench, "hash")
        .filter("own = gram")
        .groupBy(*KEYS)
        .agg(F.expr(_SPANS).alias("spans"), F.expr(_ITEMS).alias("items"))
    )
    counts = (
        own.select(*KEYS, "doc_id", F.size(item_words("text")).cast("long").alias("n_words"))
        .groupBy(*KEYS, "doc_id", "n_words")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    empty = {"spans": "array<struct<start:int,n:int>>", "items": "array<string>"}
    return counts.join(found, KEYS, "left").withColumns(
        {c: F.coalesce(c, F.array().cast(kind)) for c, kind in empty.items()}
    )


# Words inside spans that may overlap: each adds what lies beyond all before it.
_COVERED = (
    "aggregate(spans, struct(0L AS n, 0 AS seen), (a, s) -> struct("
    "a.n + greatest(0, s.start + s.n - greatest(s.start, a.seen)) AS n,"
    " greatest(a.seen, s.start + s.n) AS seen), a -> a.n)"
)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, item digest and whether it is contaminated."""
    n_hit = F.col("n_hit")
    return (
        hits(docs, items)
        .withColumn("n_hit", F.expr(_COVERED))
        .select(
            *KEYS,
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
            "items",
            "spans",
            F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("__copy"),
        )
        .drop("__copy")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    bad = cut(contamination(docs, items).filter("contaminated").select(*KEYS).distinct())
    # The list grows with the documents, so it is shuffled at every size.
    return keyed(docs).join(bad.hint("merge"), KEYS, "left_anti").select(*docs.columns)


def cut_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every document with the words of occurring windows removed from ``text``.

    Words and gaps alternate in a text; a gap goes with the word before it.
    """
    found = cut(
        hits(docs, items)
        .filter("size(spans) > 0")
        .select(*KEYS, F.col("spans").alias("__spans"))
        .dropDuplicates(KEYS)
    )
    tokens = F.expr(
        rf"regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
        rf"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*', 0)"
    )
    lead = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.array_join(
        F.expr(
            "filter(__tokens, (x, i) -> NOT exists(__spans, s -> i + 1 >= s.start AND i + 1 < s.start + s.n))"
        ),
        "",
    )
    joined = keyed(docs).join(found, KEYS, "left").withColumn("__tokens", tokens)
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.concat(lead, kept))
    return joined.withColumn("text", text).select(*docs.columns)


_DW = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_DW} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_DW} AS w FROM benchmark),
g AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n,
         unnest(list_transform(generate_series(1, greatest(1, len(w) - {WINDOW - 1})),
                               lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS gram
  FROM b WHERE len(w) > 0),
s AS MATERIALIZED (
  SELECT r, n, x.i AS i, x.gram AS gram
  FROM (SELECT r, n, unnest(list_transform(generate_series(1, len(w) - n + 1),
          lambda i: {{'i': i, 'gram': array_to_string(w[i:i + n - 1], ' ')}})) AS x
        FROM d CROSS JOIN (SELECT DISTINCT n FROM g))),
m AS (SELECT r, i, s.n, item FROM s JOIN g USING (gram) WHERE s.n = g.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit
        FROM (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY r),
its AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM m WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


@query("op10_decontaminate", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop(*KEYS, "items", "spans")
