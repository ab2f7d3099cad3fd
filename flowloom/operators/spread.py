"""Keeping hot keys from landing in one task.

A window sends every row of a partition key to one task, and a join does the
same with every row of a join key.  Adaptive execution splits a skewed join
only if both inputs are plain shuffles, and it never splits a window.  The
helpers here deal with what is left:

``with_chunks``   cuts an ordered group into consecutive pieces;
``running``       running sums and carried values over such pieces;
``join_spread``   a join with the hot keys of its larger side spread by a salt.

An input of at most ``ROWS_PER_TASK`` rows has no hot key; callers that know the
number of rows pass it as ``total`` and get the plain window or join.

Windows need no search for hot keys: pieces are cut from the sorted line of all
rows, and keys that cross a cut are known from that.  Joins start from
``hot_keys``.  It keeps only keys with more rows than
one task should take, and never more than ``MAX_HOT`` of them, because the row
limit is at least ``total / MAX_HOT``.  That bound is what makes it safe to
broadcast the hot keys, and the same limit bounds the pieces of a line with
their summaries, whatever the size of the input.  Results do not depend on the limit: it only decides
where rows are processed.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.operators.lineage import counted, cut

ROWS_PER_TASK = 1_000_000
# Counted tables of up to this many rows are broadcast, larger ones shuffled.
BROADCAST_ROWS = 500_000
MAX_HOT = 50_000
# A line is cut finer than its row count asks for, as pieces are only about equally full.
OVERSPLIT = 2


def exact_sum(df: DataFrame, value: Column) -> None:
    """Raise unless sums of ``value`` are exact, whatever is added and taken away again."""
    kind = df.select(value.alias("v")).schema["v"].dataType
    if not isinstance(kind, (T.DecimalType, T.IntegralType)):
        raise TypeError(f"{kind.simpleString()} sums lose digits: cast to a decimal first")


def fits_one_task(total: int | None, rows_per_task: int | None) -> bool:
    """Whether a counted input is so small that none of its keys can be hot."""
    return total is not None and total <= (rows_per_task or ROWS_PER_TASK)


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for key in keys:
        cond = cond & left[key].eqNullSafe(right[f"_hot_{key}"])
    return cond


def _join_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Attach the bounded ``hot`` rows; NULL keys match NULL keys."""
    renamed = hot.withColumnsRenamed({k: f"_hot_{k}" for k in keys})
    joined = df.join(F.broadcast(renamed), _same_key(df, renamed, keys), how)
    return joined.drop(*[f"_hot_{k}" for k in keys])


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    rows_per_task: int | None = None,
    counted: bool = False,
    total: int | None = None,
    **extra: Column,
) -> DataFrame:
    """Keys whose rows overfill one task, with ``_rows``, ``_parts`` and ``extra`` aggregates.

    ``counted`` says that ``df`` already holds one row per key with ``_rows``.
    A ``total`` that is not given is counted, which reads no column of a scan.
    """
    floor = float(rows_per_task or ROWS_PER_TASK)
    counts = df if counted else df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in extra.items()]
    )
    if total is not None:
        rows = F.lit(total)
    elif counted:
        rows = df.agg(F.sum("_rows")).scalar()
    else:
        rows = df.agg(F.count(F.lit(1))).scalar()
    limit = F.greatest(F.lit(floor), rows.cast("double") / MAX_HOT)
    return (
        counts.withColumn("_limit", limit)
        .filter(F.col("_rows") > F.col("_limit"))
        .withColumn("_parts", F.ceil(F.col("_rows") / F.col("_limit")).cast("int"))
        .drop("_limit")
    )


def with_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_task: int | None = None,
    total: int | None = None,
) -> DataFrame:
    """Number the consecutive pieces of each group along ``order``.

    All rows form one line, sorted by key and ``order`` (ascending, NULLs
    first), which is cut into about equally full pieces and written with the
    number of the piece.  Adds ``_hot`` for the rows of keys that lie in more
    than one piece, and ``_chunk``, the piece of such a row and 0 for all
    others.  A line of n pieces has at most n - 1 such keys.  Rows that tie in
    the key and the whole order share a piece.

    The line is read twice to be cut, so an input without a ``total`` is
    written first; one with a ``total`` is taken to be a written table.
    """
    if total is None:
        df, total = counted(df)
    limit = max(rows_per_task or ROWS_PER_TASK, total / MAX_HOT)
    pieces = max(1, OVERSPLIT * math.ceil(total / limit))
    spots = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    line = cut(df.repartitionByRange(pieces, *spots).withColumn("_piece", F.spark_partition_id()))
    crossing = cut(
        line.groupBy(*keys)
        .agg(F.min("_piece").alias("_from"), F.max("_piece").alias("_to"))
        .filter("_from < _to")
        .select(*keys, F.lit(True).alias("_hot"))
    )
    return (
        _join_hot(line, crossing, keys, "left")
        .withColumn("_hot", F.coalesce("_hot", F.lit(False)))
        .withColumn("_chunk", F.when(F.col("_hot"), F.col("_piece")).otherwise(0))
        .drop("_piece")
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    peers: bool = False,
    inclusive: bool = True,
    rows_per_task: int | None = None,
    total: int | None = None,
) -> DataFrame:
    """Running values per group, in two levels so that no group needs one task.

    ``order`` is ascending, NULLs first; large groups are cut along it.
    ``sums`` adds running sums of non-NULL expressions, ``lasts`` the latest
    non-NULL value so far, ``totals`` sums over the whole group.  ``peers``
    counts rows that tie in the order as one step, as a RANGE frame does.
    ``inclusive=False`` stops before the current row.

    Inside a piece this is a plain window.  The start value of a piece comes
    from one summary row per earlier piece of the same group.  The input is
    read once: without a ``total`` it is counted while it is written.
    """
    sums, lasts, totals = dict(sums or {}), dict(lasts or {}), dict(totals or {})
    prepared = df.withColumns(
        {f"_in_{n}": c for n, c in (sums | lasts | totals).items()}
    )
    if total is None:
        prepared, total = counted(prepared)
    small = fits_one_task(total, rows_per_task)
    rows = prepared if small else with_chunks(prepared, keys, order, rows_per_task, total)
    piece = [*keys] if small else [*keys, "_chunk"]
    ordered = Window.partitionBy(*piece).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    end = Window.currentRow if inclusive else -1
    frame = (
        ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        if peers
        else ordered.rowsBetween(Window.unboundedPreceding, end)
    )
    whole = Window.partitionBy(*piece)
    local = {f"_at_{n}": F.sum(f"_in_{n}").over(frame) for n in sums}
    local |= {f"_at_{n}": F.last(f"_in_{n}", ignorenulls=True).over(frame) for n in lasts}
    local |= {f"_at_{n}": F.sum(f"_in_{n}").over(whole) for n in totals}

    at = rows.withColumns(local)
    if small:
        return _finish(df, at, sums, lasts, totals, carried=False)

    latest = F.struct(*order)
    summary = (
        rows.filter("_hot")
        .groupBy(*piece)
        .agg(
            F.lit(True).alias("_one"),
            *[F.sum(f"_in_{n}").alias(f"_s_{n}") for n in (sums | totals)],
            *[
                F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), latest)).alias(f"_s_{n}")
                for n in lasts
            ],
        )
    )
    chain = Window.partitionBy(*keys).orderBy("_chunk")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    carry = summary.select(
        *piece,
        *[F.sum(f"_s_{n}").over(before).alias(f"_carry_{n}") for n in sums],
        *[F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_carry_{n}") for n in lasts],
        *[F.sum(f"_s_{n}").over(group).alias(f"_carry_{n}") for n in totals],
    )

    return _finish(df, _join_hot(at, carry, piece, "left"), sums, lasts, totals, carried=True)


def _finish(df, at, sums, lasts, totals, carried: bool) -> DataFrame:
    """Put the value inside the piece and the value before it together."""

    def start(name: str) -> Column:
        return F.col(f"_carry_{name}") if carried else F.lit(None)

    result = {}
    for n in sums:
        dtype = at.schema[f"_at_{n}"].dataType
        zero = F.lit(0).cast(dtype)
        result[n] = (F.coalesce(f"_at_{n}", zero) + F.coalesce(start(n), zero)).cast(dtype)
    for n in lasts:
        result[n] = F.coalesce(f"_at_{n}", start(n))
    for n in totals:
        result[n] = F.coalesce(start(n), f"_at_{n}")
    kept = [c for c in df.columns if c not in result]
    return at.select(*kept, *[c.alias(n) for n, c in result.items()])


def salt_rows(big: DataFrame, on: Sequence[str], hot: DataFrame) -> DataFrame:
    """Give each row of a hot key one of ``_parts`` salts, by a hash of the row."""
    salt = F.pmod(F.xxhash64(*big.columns), F.col("_parts")).cast("int")
    spread = _join_hot(big, hot.select(*on, "_parts"), on, "left")
    return spread.withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_parts")


def copy_rows(small: DataFrame, on: Sequence[str], hot: DataFrame) -> DataFrame:
    """Copy each row of a hot key to all of its salts."""
    salts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    copied = _join_hot(small, hot.select(*on, "_parts"), on, "left")
    return copied.withColumn("_salt", F.explode(salts)).drop("_parts")


def join_spread(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    rows_per_task: int | None = None,
    hot: DataFrame | None = None,
    nulls_match: bool = False,
    total: int | None = None,
) -> DataFrame:
    """Join on equal keys with the hot keys of ``big`` spread over several tasks.

    A row of ``big`` goes to one salt of its key and the matching rows of
    ``small`` are copied to each, so every match is made exactly once.  ``how``
    is ``inner`` or ``left``.  Copies of one identical row share a salt: count
    them first.  ``hot`` saves finding the hot keys again.
    """
    on = [on] if isinstance(on, str) else list(on)
    if fits_one_task(total, rows_per_task):
        left, right, keys = big, small, on
    else:
        hot = hot_keys(big, on, rows_per_task, total=total) if hot is None else hot
        left, right, keys = salt_rows(big, on, hot), copy_rows(small, on, hot), [*on, "_salt"]
    if not nulls_match:
        return left.join(right, keys, how).drop("_salt")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, cond, how).drop("_salt", *[f"_r_{k}" for k in keys])
