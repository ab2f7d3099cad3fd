"""Summaries that are kept as a table and merged later: quantiles and distinct senders.

A sketch is one binary value per group, bounded in size whatever the group holds.  Fine
groups (a day, a month) are sketched once; any coarser answer merges their rows
and never reads the data again.  Partial sketches are merged before the shuffle, so
a group with most of the rows sends one value per task.

The error is stated, not hoped for: ``rank_error`` for quantiles, as a share of the
rows, and ``count_error`` for distinct counts, as a share of the union.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entries that a quantile sketch keeps per level, and log2 of the entries of a set sketch.
QUANTILE_K = 800
SET_LOG2 = 12
# Published bounds hold in 99 of 100 cases, or within one standard error; checks allow
# so many times as much.
RANK_MARGIN, COUNT_MARGIN = 3, 4


def rank_error(k: int = QUANTILE_K) -> float:
    """How far the rank of a sketched quantile is off at 99 % confidence, as a share of the rows."""
    return 2.296 / k**0.9723


def count_error(log2: int = SET_LOG2) -> float:
    """Standard error of a sketched count, as a share of it; of a set operation, of the union."""
    return 1 / (2**log2 - 2) ** 0.5


def quantile_sketches(df: DataFrame, by: Sequence[str | Column], col: str, k: int = QUANTILE_K) -> DataFrame:
    """One sketch of the non-NULL values of ``col`` per group; groups without values have none."""
    values = df.filter(F.col(col).isNotNull())
    return values.groupBy(*by).agg(
        F.kll_sketch_agg_double(F.col(col).cast("double"), F.lit(k)).alias("sketch")
    )


def merge_quantiles(sketches: DataFrame, by: Sequence[str], k: int = QUANTILE_K) -> DataFrame:
    """One sketch per coarser group, with the number of values in it."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return merged.withColumn("n_values", F.kll_sketch_get_n_double("sketch"))


def sketched_quantiles(merged: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The group columns of ``merged`` and one column for each of ``probs``."""
    found = [
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"q{round(p * 100)}") for p in probs
    ]
    return merged.select(*[c for c in merged.columns if c not in ("sketch", "n_values")], *found)


def rank_off(df: DataFrame, quantiles: DataFrame, by: str, col: str, probs: Sequence[float]) -> DataFrame:
    """How far each quantile in ``quantiles`` is from its rank in ``df``, the worst per group, as a share.

    Rows equal to the value cover a range of ranks; within it a quantile is not off.
    """
    named = quantiles.withColumnsRenamed({f"q{round(p * 100)}": f"_q{i}" for i, p in enumerate(probs)})
    rows = df.filter(F.col(col).isNotNull()).join(named, by)
    value, n = F.col(col).cast("double"), F.count(F.lit(1))
    off = []
    for i, p in enumerate(probs):
        below, upto = F.count_if(value < F.col(f"_q{i}")) / n, F.count_if(value <= F.col(f"_q{i}")) / n
        off.append(F.greatest(below - p, p - upto, F.lit(0.0)))
    return rows.groupBy(by).agg(F.greatest(*off, F.lit(0.0)).alias("rank_off"))


def set_sketches(df: DataFrame, by: Sequence[str | Column], col: str, log2: int = SET_LOG2) -> DataFrame:
    """One sketch of the distinct values of ``col`` per group; exact up to ``2 ** log2`` of them."""
    return df.filter(F.col(col).isNotNull()).groupBy(*by).agg(
        F.theta_sketch_agg(F.col(col), F.lit(log2)).alias("sketch")
    )


def merge_sets(sketches: DataFrame, by: Sequence[str], log2: int = SET_LOG2) -> DataFrame:
    """The union of the sketches per coarser group, with its estimated count."""
    merged = sketches.groupBy(*by).agg(F.theta_union_agg("sketch", F.lit(log2)).alias("sketch"))
    return merged.withColumn("n_approx", F.theta_sketch_estimate("sketch"))


def turnover_of(sketches: DataFrame, period: str) -> DataFrame:
    """Estimated values kept, lost and gained from each ``period`` (a number) to the next one.

    Only periods whose next one is there too; ``n_union`` is what the errors are a share of.
    """
    now = sketches.select(period, F.col("sketch").alias("_a"))
    then = sketches.select((F.col(period) - 1).alias(period), F.col("sketch").alias("_b"))
    count = F.theta_sketch_estimate
    return now.join(then, period).select(
        period,
        count(F.theta_intersection("_a", "_b")).alias("kept_approx"),
        count(F.theta_difference("_a", "_b")).alias("lost_approx"),
        count(F.theta_difference("_b", "_a")).alias("gained_approx"),
        count(F.theta_union("_a", "_b")).alias("n_union"),
    )
