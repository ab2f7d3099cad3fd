"""What the operators of this package share: the registry, row keys and word splitting.

Row keys.  Operators that bring a result back to a document use the pair
``__k1``, ``__k2`` made from ``doc_id`` and the text.  It needs no numbering
pass, is the same whenever a lost task runs again, and takes NULL ids.  Rows
that agree in both id and text count as one document and get equal results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KEYS = ["__k1", "__k2"]

# ASCII white space as a Java pattern, and the ASCII capitals.
BLANKS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say the same, that SQL."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the row key; columns of these names are replaced."""
    missing = F.col("doc_id").isNull()
    return df.withColumns(
        {
            "__k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
            "__k2": F.xxhash64(missing, F.col(text).isNull(), F.col(text)),
        }
    )


def words(text: str) -> Column:
    """Runs of anything but ASCII white space; NULL text has none."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BLANKS), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else changed.

    ``lower`` also changes other alphabets, so it is used only where every
    character is one byte long.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, CAPITALS, CAPITALS.lower())
    )


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 modulo 4.

    A NULL id has no remainder and is not held out.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
