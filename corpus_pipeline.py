"""From raw documents to a training mixture in five stages.

Every stage takes the documents that the one before kept and returns documents
again; the last returns the mixture: a row for each stretch of a document taken,
with the document's columns, its ``shard`` and ``position``, the ``turn`` through
its source, and the words ``first_word`` to ``last_word`` (from 0, end excluded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules
from flowloom.llm.common import KEYS, keyed, table
from flowloom.operators.lineage import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no base rule and whose host is not rejected."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages are cut out; documents left without a word go.

    ``n_chars`` follows the text where something was removed.
    """
    done = line_dedup.dedup_lines(docs)
    changed = F.col("n_removed") > 0
    n_chars = F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")
    return (
        done.filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        .withColumn("n_chars", n_chars)
        .select(*docs.columns)
    )


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stretches taken, each with its document."""
    _, _, taken = mixing.mix(docs)
    taken = taken.select(
        *KEYS, "shard", "position", "turn",
        F.col("begin").alias("first_word"), F.col("end").alias("last_word"),
    )
    # Rows of equal id and text have equal keys; each was placed by itself.
    own = keyed(docs).drop(*[c for c in taken.columns if c not in KEYS]).dropDuplicates(KEYS)
    return taken.join(own.hint("merge"), KEYS).drop(*KEYS)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontaminate", benchmark),
    ("mixing", mixture),
]

# Signatures and seeded draws have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
