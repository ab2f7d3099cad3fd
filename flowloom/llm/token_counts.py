"""Token counts of whole texts without making the ids of whole texts.

A byte-level tokenizer cuts a text into pre-tokens and merges bytes inside each
of them only.  So every distinct pre-token is encoded once for the whole
corpus, and a document's count is the sum over its pre-token frequencies:

1. one pass counts pre-tokens per task; a shuffle adds the counts up;
2. every distinct pre-token is encoded once, and only its length is kept;
3. a second pass looks up the pre-tokens of each document.  The most frequent
   ones, at most ``frequent`` of at most ``LONGEST`` characters each, are a
   dictionary of bounded size sent to all workers.  All others leave the pass
   as rows (document, pre-token, frequency), are joined to the table of step 2
   and summed, however many there are.

Empty and NULL texts have no token.  Rows equal in every column give equal
rows.  An added token of the tokenizer that occurs in a text counts as one, as
the library has it by default.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import query, table
from flowloom.operators.lineage import cut

FREQUENT = 262_144
LONGEST = 64
# A worker's tally is handed on when it has this many entries.
TALLY = 200_000
OVER = 1024

# The pre-token classes for texts of Latin letters and common
# punctuation.  Any other text is cut by the tokenizer library itself, since
# tables of letters and digits differ between versions of Unicode.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGIT = "0-9²³¹¼½¾"
_SPACE = r"\t-\r "
_PIECE = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_UNUSUAL = re.compile("[^\\t-\\r -~¡-ɏ‐-‧€]")


class PreTokens:
    """Cuts texts the way one tokenizer file does."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level tokenizers cut texts into independent pieces")
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not handled")
        # The longest first, as the library prefers the longest match.
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self._added = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None

    def __call__(self, text: str) -> list[str]:
        if self._added is None or not self._added.search(text):
            return self._plain(text)
        found: list[str] = []
        for i, part in enumerate(self._added.split(text)):
            if i % 2:
                found.append(part)
            elif part:
                found.extend(self._plain(part))
        return found

    def _plain(self, text: str) -> list[str]:
        if _UNUSUAL.search(text):
            cut_at = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            return [text[a:b] for _, (a, b) in cut_at]
        return _PIECE.findall(text)

    def lengths(self, pieces: list[str]) -> list[int]:
        encoded = self.tokenizer.encode_batch(pieces, add_special_tokens=False)
        return [len(e) for e in encoded]


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    """One per worker process."""
    return PreTokens(path)


def _strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every distinct pre-token with its number of occurrences and of tokens."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = pre_tokens(path), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [_strings(list(seen.keys())), pa.array(list(seen.values()), pa.int64())],
                ["piece", "n"],
            )

        for batch in batches:
            for value in batch.column(0):
                seen.update(cutter(value.as_py()))
                if len(seen) > TALLY:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pre_tokens(path)
        for batch in batches:
            sizes = cutter.lengths(batch.column("piece").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("piece"), batch.column("n"), pa.array(sizes, pa.int64())],
                ["piece", "n", "tokens"],
            )

    counted = (
        docs.select(F.col(text).alias("text"))
        .filter("text <> ''")
        .mapInArrow(tally, "piece string, n long")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
    )
    return counted.mapInArrow(encode, "piece string, n long, tokens long")


def _frequent(vocab: DataFrame, most: int) -> dict[str, int]:
    """The pre-tokens at or above the least frequency that at most ``most`` reach."""
    top = 1_000_000
    short = vocab.filter(F.char_length("piece") <= LONGEST)
    # At most ``most`` distinct frequencies can matter, as each has a pre-token.
    steps = (
        short.groupBy(F.least("n", F.lit(top)).alias("n"))
        .agg(F.count(F.lit(1)).alias("pieces"))
        .orderBy(F.desc("n"))
        .limit(most)
        .collect()
    )
    least, total = top + 1, 0
    for step in steps:
        total += step["pieces"]
        if total > most:
            break
        least = step["n"]
    rows = short.filter(F.col("n") >= least).select("piece", "tokens").collect() if steps else []
    return {r["piece"]: r["tokens"] for r in rows}


def count_tokens(
    docs: DataFrame, path: str, text: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of each row of ``docs``."""
    spark = docs.sparkSession
    vocab = cut(vocabulary(docs, path, text))
    known = spark.sparkContext.broadcast(_frequent(vocab, frequent))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, sizes = pre_tokens(path), known.value
        for batch in batches:
            sums, rare, often = [], [], []
            for value in batch.column("text"):
                pieces = cutter(value.as_py() or "")
                found = list(map(sizes.get, pieces))
                missing: Counter = Counter()
                if None in found:
                    missing.update(p for p, n in zip(pieces, found) if n is None)
                    found = [n for n in found if n is not None]
                sums.append(sum(found))
                rare.append(list(missing.keys()))
                often.append(list(missing.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_bytes"),
                    pa.array(sums, pa.int64()),
                    pa.array(rare, pa.list_(pa.string())),
                    pa.array(often, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_bytes", "tokens", "rare", "often"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).alias("text"),
    ).mapInArrow(
        look_up,
        "doc_id long, n_bytes long, tokens long, rare array<string>, often array<long>",
    )
    # Row numbers are safe from here on: they are written once and then only read.
    base = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    rest = (
        base.filter(F.size("rare") > 0)
        .select("row", F.explode(F.arrays_zip("rare", "often")).alias("x"))
        .select("row", F.col("x.rare").alias("piece"), F.col("x.often").alias("often"))
        .join(vocab.select("piece", F.col("tokens").alias("size")), "piece")
        .groupBy("row")
        .agg(F.sum(F.col("often") * F.col("size")).alias("more"))
    )
    return base.select("row", "doc_id", "n_bytes", "tokens").join(rest, "row", "left").select(
        "doc_id",
        "n_bytes",
        (F.col("tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, tokenizer_path()).withColumn(
        "over_limit", F.col("n_tokens") > OVER
    )
