"""Joins between flows, their dimensions and event sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.lineage import cut
from flowloom.operators.spread import exact_sum, running


def equi_join(
    df: DataFrame, other: DataFrame, on: str | Sequence[str], how: str = "inner"
) -> DataFrame:
    """Inner or left outer join on equal keys."""
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    return df.join(other, on, how)


def active(who: DataFrame, f: DataFrame, key: str) -> DataFrame:
    """Rows of ``who`` that occur in ``f``."""
    return who.join(f.select(key).distinct(), key, "left_semi")


def inactive(who: DataFrame, f: DataFrame, key: str) -> DataFrame:
    """Rows of ``who`` that do not occur in ``f``."""
    return who.join(f.select(key).distinct(), key, "left_anti")


def both_ways(e: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Each unordered pair of places once, per key in ``also``, with the weight of either direction.

    A full outer join of the edge list with its own reverse: the forward side
    keeps edges with ``src < dst``, the backward side the others.  Edges from a
    place to itself are left out.
    """
    e = cut(e)
    forward = e.filter("src < dst").select(
        F.col("src").alias("a"), F.col("dst").alias("b"), *also, F.col("weight").alias("forward")
    )
    backward = e.filter("src > dst").select(
        F.col("dst").alias("a"), F.col("src").alias("b"), *also, F.col("weight").alias("backward")
    )
    zero = F.lit(0).cast(e.schema["weight"].dataType)
    return forward.join(backward, ["a", "b", *also], "full").select(
        "a",
        "b",
        *also,
        F.coalesce("forward", zero).alias("forward"),
        F.coalesce("backward", zero).alias("backward"),
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    by: str,
    on: str,
    tie: str,
    prefix: str = "prev_",
    rows_per_task: int | None = None,
) -> DataFrame:
    """Each left row with the last strictly earlier right row of the same key.

    Rows of both sides go into one sequence per key, and the latest right row
    is carried along it: linear in the rows, no pairs are formed.  Right rows
    that tie in time are told apart by ``tie``, the greatest wins.  Rows without
    a key or a time match nothing.
    """
    right = right.filter(F.col(by).isNotNull() & F.col(on).isNotNull())
    taken = [c for c in right.columns if c != by]
    lefts = left.select("*", F.lit(0).alias("_side"), F.lit(None).alias("_row"))
    rights = right.select(
        by, on, tie, F.lit(1).alias("_side"), F.struct(*taken).alias("_row")
    )
    line = lefts.unionByName(rights, allowMissingColumns=True)
    seen = running(
        line,
        [by],
        [on, "_side", tie],
        lasts={"_match": F.col("_row")},
        rows_per_task=rows_per_task,
    )
    match = F.when(F.col(by).isNotNull(), F.col("_match"))
    return seen.filter("_side = 0").select(
        *left.columns, *[match.getField(c).alias(f"{prefix}{c}") for c in taken]
    )


def band_totals(
    left: DataFrame,
    right: DataFrame,
    by: str,
    on: str,
    span: str,
    value: Column,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Number and total of right rows in the ``span`` before each left row, per key.

    The band is ``[on - span, on)``.  Matching pairs are never formed: a right
    row enters the running total at its time and leaves it ``span`` later, so a
    key with many rows costs as much as many keys with few.  What enters must
    leave without a trace, so ``value`` has to be a decimal or an integer.
    """
    exact_sum(right, value)
    width = F.expr(f"INTERVAL {span}")
    lefts = left.select(
        "*", F.lit(0).alias("_side"), F.lit(None).alias("_v"), F.lit(0).alias("_n")
    )
    enter = right.select(by, on, F.lit(1).alias("_side"), value.alias("_v"), F.lit(1).alias("_n"))
    leave = enter.select(
        by, (F.col(on) + width).alias(on), "_side", (-F.col("_v")).alias("_v"), (-F.col("_n")).alias("_n")
    )
    line = lefts.unionByName(enter, True).unionByName(leave, True)
    seen = running(
        line,
        [by],
        [on, "_side"],
        sums={"n_in_band": F.col("_n"), "sum_in_band": F.col("_v")},
        rows_per_task=rows_per_task,
    )
    known = F.col(by).isNotNull() & F.col(on).isNotNull()
    n = F.when(known, F.col("n_in_band")).otherwise(F.lit(0)).cast("bigint")
    total = F.when(known & (F.col("n_in_band") > 0), F.col("sum_in_band"))
    return seen.filter("_side = 0").select(
        *left.columns, n.alias("n_in_band"), total.alias("sum_in_band")
    )
