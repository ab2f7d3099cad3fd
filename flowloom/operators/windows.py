"""Time series, rankings and shares.

Time series are aggregated to one row per place and period before a window
sees them, so a window partition is as long as the calendar.  Windows over raw
rows go through ``running``, which cuts long groups into pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import fixed, money, period_start, ratio
from flowloom.operators.lineage import cut
from flowloom.operators.spread import BROADCAST_ROWS, exact_sum, join_spread, running

# Fixed value: the largest bound on a row number that Spark applies before the shuffle.
GROUP_LIMIT = 1000


def resample(f: DataFrame, unit: str, by: Sequence[str] = ()) -> DataFrame:
    """Flows and value per period and group."""
    return f.groupBy(*by, period_start(F.col("ts"), unit).alias("period")).agg(
        F.count(F.lit(1)).alias("n_flows"), money(F.sum("value")).alias("total_value")
    )


def fill_gaps(
    daily: DataFrame,
    by: Sequence[str],
    lo: Column | None = None,
    hi: Column | None = None,
    step: str = "1 DAY",
) -> DataFrame:
    """One row per group and period between ``lo`` and ``hi``, zero where nothing happened.

    The bounds default to the first and last period of the whole frame.
    """
    daily = cut(daily)
    lo = daily.agg(F.min("period")).scalar() if lo is None else lo
    hi = daily.agg(F.max("period")).scalar() if hi is None else hi
    spine = (
        daily.select(*by)
        .distinct()
        .withColumn("period", F.explode(F.sequence(lo, hi, F.expr(f"INTERVAL {step}"))))
    )
    filled = spine.join(daily, [*by, "period"], "left")
    numbers = [c for c in daily.columns if c not in (*by, "period")]
    return filled.select(
        *by,
        "period",
        *[F.coalesce(c, F.lit(0).cast(daily.schema[c].dataType)).alias(c) for c in numbers],
    )


def _calendar(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy(F.col("period").asc_nulls_first())


def period_change(m: DataFrame, by: Sequence[str]) -> DataFrame:
    """Difference and ratio to the period before."""
    before = F.lag("total_value").over(_calendar(by))
    return m.withColumn("_before", before).select(
        *by,
        "period",
        "total_value",
        money(F.col("total_value") - F.col("_before")).alias("change"),
        ratio(F.col("total_value"), F.col("_before")).alias("growth"),
    )


def rolling(daily: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Totals over the last ``n`` periods; gaps must have been filled."""
    w = _calendar(by).rowsBetween(-(n - 1), Window.currentRow)
    return daily.select(
        *by,
        "period",
        F.sum("n_flows").over(w).alias("n_rolling"),
        money(F.sum("total_value").over(w)).alias("value_rolling"),
    )


def rolling_time(
    events: DataFrame,
    by: str,
    span: str,
    value: Column,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Rows and total of the same group within ``span`` up to each row, ties included.

    Each row enters a running total at its time and leaves it right after
    ``span``, which costs the same however many rows fall into the span.  What
    enters must leave without a trace: ``value`` has to be a decimal or integer.
    """
    exact_sum(events, value)
    width = F.expr(f"INTERVAL {span}")
    enter = events.withColumns(
        {
            "_kind": F.lit(0),
            "_v": value,
            "_n": F.lit(1),
            "_known": F.when(value.isNotNull(), 1).otherwise(0),
        }
    )
    leave = enter.select(
        by,
        (F.col("ts") + width).alias("ts"),
        F.lit(1).alias("_kind"),
        *[(-F.col(c)).alias(c) for c in ("_v", "_n", "_known")],
    )
    seen = running(
        enter.unionByName(leave, allowMissingColumns=True),
        [by],
        ["ts", "_kind"],
        sums={"n_rolling": F.col("_n"), "_total": F.col("_v"), "_some": F.col("_known")},
        peers=True,
        rows_per_task=rows_per_task,
    )
    return seen.filter("_kind = 0").select(
        *events.columns,
        "n_rolling",
        F.when(F.col("_some") > 0, F.col("_total")).alias("value_rolling"),
    )


def running_total(m: DataFrame, by: Sequence[str]) -> DataFrame:
    """Value so far, period by period."""
    w = _calendar(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.select(*by, "period", money(F.sum("total_value").over(w)).alias("value_so_far"))


def time_bucket(events: DataFrame, width: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts per fixed-width bucket, counted from midnight of 1970-01-01."""
    return (
        events.groupBy(*by, F.window("ts", width).alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.sum(fixed(F.col("value"), 2)).cast("decimal(38,2)").alias("sum_value"),
        )
        .select(*by, F.col("_w.start").alias("bucket_start"), "n_events", "sum_value")
    )


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in a total order.

    The bound on the row number lets Spark cut each group before the shuffle, up to
    ``GROUP_LIMIT`` rows.  ``top_ranks`` takes more without a task that holds a group.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def top_ranks(
    df: DataFrame,
    group: Sequence[str],
    col: str,
    n: int,
    dense: bool = False,
    rows_per_task: int | None = None,
) -> DataFrame:
    """All rows of each group whose ``rank`` (or ``dense_rank``) by ``col``, greatest first, is up to ``n``.

    Any number of rows may tie, so rows are not ranked themselves: the ``n``
    greatest distinct values of each group are, with their row counts, and the
    rows that hold one of those values are kept.  Up to ``GROUP_LIMIT`` places the
    values are cut before they are shuffled; for more they are ranked from the other
    end by running counts, which no group keeps in one task.
    """
    values = df.groupBy(*group, col).agg(F.count(F.lit(1)).alias("_n"))
    ranked = _first_values if n <= GROUP_LIMIT else _ranked_values
    wanted = cut(
        ranked(values, group, col, n, dense, rows_per_task)
        .filter(F.col("place") <= n)
        .select(*group, col, F.col("place").cast("int").alias("place"))
    )
    keys = [*group, col]
    if wanted.count() > BROADCAST_ROWS:
        return join_spread(cut(df), wanted, keys, rows_per_task=rows_per_task, nulls_match=True)
    named = wanted.withColumnsRenamed({k: f"_w_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(named[f"_w_{k}"])
    return df.join(F.broadcast(named), same).drop(*[f"_w_{k}" for k in keys])


def _first_values(values, group, col, n, dense, rows_per_task) -> DataFrame:
    """The first ``n`` values of each group, ranked in one window."""
    order = F.col(col).desc_nulls_last()
    first = top_n(values, group, [order], n)
    if dense:
        return first
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("place", F.coalesce(F.sum("_n").over(w), F.lit(0)) + 1)


def _ranked_values(values, group, col, n, dense, rows_per_task) -> DataFrame:
    """All values, ranked by what is left of the group above them."""
    counts = {"_values": F.lit(1), "_rows": F.col("_n")}
    seen = running(
        values,
        group,
        [col],
        sums={f"{c}_upto": v for c, v in counts.items()},
        totals={f"{c}_all": v for c, v in counts.items()},
        rows_per_task=rows_per_task,
    )
    c = "_values" if dense else "_rows"
    return seen.withColumn("place", F.col(f"{c}_all") - F.col(f"{c}_upto") + 1)


def share(df: DataFrame, group: Sequence[str], rows_per_task: int | None = None) -> DataFrame:
    """Share of each row of an aggregated frame in the value of its group."""
    df = cut(df)
    totals = df.groupBy(*group).agg(F.sum("total_value").alias("_whole"))
    joined = join_spread(
        df, totals, group, rows_per_task=rows_per_task, nulls_match=True, total=df.count()
    )
    return joined.select(*df.columns, ratio(F.col("total_value"), F.col("_whole")).alias("share"))


def concentration(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sum of squared shares: 1 if all value goes one way.

    Equals the sum of squares over the square of the sum, so it takes a single
    aggregation.
    """
    v = F.col("total_value").cast("double")
    total = F.sum("total_value").cast("double")
    return df.groupBy(*group).agg(
        F.round(F.try_divide(F.sum(v * v), total * total), 6).alias("concentration")
    )


def distribution(
    df: DataFrame, by: str, col: str, tie: str, tiles: int, rows_per_task: int | None = None
) -> DataFrame:
    """``ntile``, ``percent_rank`` and ``cume_dist`` of each row within its group.

    Counts per distinct value give the rows before and up to each value and the
    size of the group.  Rows that tie are numbered among themselves by ``tie``,
    so a value shared by very many rows can be cut into pieces as well.
    """
    df = cut(df)
    n = df.count()
    counted = df.groupBy(by, col).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(
        counted,
        [by],
        [col],
        sums={"_upto": F.col("_n")},
        totals={"_all": F.col("_n")},
        rows_per_task=rows_per_task,
        total=n,
    )
    numbered = running(
        df, [by, col], [tie], sums={"_in": F.lit(1)}, rows_per_task=rows_per_task, total=n
    )
    rows = join_spread(
        numbered, ranked, [by, col], rows_per_task=rows_per_task, nulls_match=True, total=n
    )
    before, size = F.col("_upto") - F.col("_n"), F.col("_all")
    row = before + F.col("_in")
    small = F.floor(size / tiles)
    large_rows = (size % tiles) * (small + 1)
    tile = F.when(row <= large_rows, F.floor((row - 1) / (small + 1))).otherwise(
        size % tiles + F.floor(F.try_divide(row - 1 - large_rows, small))
    )
    return rows.select(
        *df.columns,
        (tile + 1).cast("int").alias("tile"),
        F.round(F.coalesce(F.try_divide(before, size - 1), F.lit(0.0)), 9).alias("percent_rank"),
        F.round(F.col("_upto") / size, 9).alias("cume_dist"),
    )


def top_n_plus_other(
    df: DataFrame, group: Sequence[str], label: str, n: int, other: str = "OTHER"
) -> DataFrame:
    """The ``n`` largest rows of each group and one row for all the rest.

    The rest is the total of the group less its largest rows, so only those
    are ever ranked.
    """
    df = cut(df)
    order = [F.col("total_value").desc_nulls_last(), F.col(label).asc_nulls_first()]
    top = top_n(df, group, order, n).select(*group, label, "total_value")
    sums = (
        df.select(*group, "total_value", F.lit(1).alias("_n"))
        .unionByName(
            top.select(*group, (-F.col("total_value")).alias("total_value"), F.lit(-1).alias("_n"))
        )
        .groupBy(*group)
        .agg(money(F.sum("total_value")).alias("total_value"), F.sum("_n").alias("_n"))
    )
    rest = sums.filter("_n > 0").select(*group, F.lit(other).alias(label), "total_value")
    # A label that reads like the rest is counted with it.
    return (
        top.withColumn("total_value", money(F.col("total_value")))
        .unionByName(rest)
        .groupBy(*group, label)
        .agg(money(F.sum("total_value")).alias("total_value"))
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of the whole frame; every task keeps ``k`` rows only."""
    return df.orderBy(*order).limit(k)
