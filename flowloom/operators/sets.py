"""Set operations between populations of two periods.

Inputs are made distinct before they meet, so a sender with many flows counts
as one row from the first shuffle on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def kept(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both."""
    return a.distinct().intersect(b.distinct())


def lost(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` missing from ``b``."""
    return a.distinct().subtract(b.distinct())


def turnover(a: DataFrame, b: DataFrame) -> DataFrame:
    """Which rows were kept, are new or were lost between two periods.

    Says in one aggregation what the two set operations would say in three.
    """
    marked = a.withColumn("_p", F.lit(1)).unionByName(b.withColumn("_p", F.lit(2)))
    first, last = F.min("_p"), F.max("_p")
    status = F.when(last == 1, "lost").when(first == 2, "new").otherwise("kept")
    return marked.groupBy(*a.columns).agg(status.alias("status"))


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common rows, as often as they occur in both."""
    return a.intersectAll(b)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` less as many copies as ``b`` holds."""
    return a.exceptAll(b)
