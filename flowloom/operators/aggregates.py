"""Summaries of flows and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import money
from flowloom.operators.lineage import cut
from flowloom.operators.spread import running


def route_summary(f: DataFrame) -> DataFrame:
    """Count, total, mean, extremes and number of assets of each route."""
    return f.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n_flows"),
        money(F.sum("value")).alias("total_value"),
        F.round(F.try_divide(F.sum("value").cast("double"), F.count("value")), 4).alias("mean_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.count_distinct("asset").alias("n_assets"),
    )


def _levels(keys: Sequence[str]) -> list[Column]:
    return [F.grouping(k).cast("int").alias(f"all_{k}") for k in keys]


def _totals() -> list[Column]:
    return [F.sum("_n").alias("n_flows"), money(F.sum("_v")).alias("total_value")]


def _finest(f: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals at the finest level, which all coarser ones add up from.

    Grouping sets copy their input once per set; this way they copy groups
    instead of flows.
    """
    return f.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_v"))


def rolled_up(f: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals at every prefix of ``keys``; ``all_k`` is 1 where ``k`` is summed over."""
    return _finest(f, keys).rollup(*keys).agg(*_levels(keys), *_totals())


def cubed(f: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals at every subset of ``keys``."""
    return _finest(f, keys).cube(*keys).agg(*_levels(keys), *_totals())


def grouped_by_sets(
    f: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str]
) -> DataFrame:
    """Totals at the chosen subsets of ``keys``."""
    chosen = [[F.col(c) for c in s] for s in sets]
    grouped = _finest(f, keys).groupingSets(chosen, *[F.col(k) for k in keys])
    return grouped.agg(*_levels(keys), *_totals())


def listed(dimension: DataFrame, key: str, most: int = 1000) -> list:
    """The keys of a small dimension; a table too large to be columns is an error."""
    keys = [r[0] for r in dimension.select(key).distinct().orderBy(key).limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"more than {most} values of {key}")
    return keys


def route_matrix(f: DataFrame, places: Sequence[int]) -> DataFrame:
    """Number of flows, one row per source and one column per destination.

    ``to_other`` counts the flows to no place of the list, so rows add up.
    """
    n = F.count(F.lit(1))
    wide = f.groupBy("src").agg(
        *[F.count_if(F.col("dst") == p).alias(f"to_{p}") for p in places], n.alias("to_other")
    )
    rest = F.col("to_other")
    for p in places:
        rest = rest - F.col(f"to_{p}")
    return wide.withColumn("to_other", rest)


def melt(wide: DataFrame, ids: Sequence[str], name: str, value: str) -> DataFrame:
    """The columns other than ``ids`` as rows of ``(name, value)``."""
    return wide.unpivot(list(ids), [c for c in wide.columns if c not in ids], name, value)


def quantiles(
    df: DataFrame,
    by: str,
    col: str,
    probs: Sequence[float],
    digits: int = 6,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Exact quantiles per group, interpolated between neighbours.

    Equal values are counted first.  Running counts over the sorted values then
    show which value stands at a rank, and one more aggregation picks the two
    ranks around each quantile.  No group is held in memory.
    """
    counted = cut(
        df.filter(F.col(col).isNotNull())
        .groupBy(by, col)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running(
        counted,
        [by],
        [col],
        sums={"_end": F.col("_n")},
        totals={"_all": F.col("_n")},
        rows_per_task=rows_per_task,
        total=counted.count(),
    )
    start = F.col("_end") - F.col("_n")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (rank < F.col("_end")), F.col(col)))

    picks, results = [], []
    for i, p in enumerate(probs):
        at = (F.col("_all") - 1) * F.lit(float(p))
        picks += [
            value_at(F.floor(at)).alias(f"_a{i}"),
            value_at(F.ceil(at)).alias(f"_b{i}"),
            F.max(at - F.floor(at)).alias(f"_f{i}"),
        ]
        low, high, part = F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_f{i}")
        results.append(F.round(low + (high - low) * part, digits).alias(f"q{round(p * 100)}"))
    return ranked.groupBy(by).agg(*picks).select(by, *results)


def distinct_senders(f: DataFrame, by: str) -> DataFrame:
    """Exact number of distinct senders per group."""
    return f.groupBy(by).agg(F.count_distinct("sender").alias("n_senders"))


SKETCH_RSD = 0.02


def approx_distinct_senders(f: DataFrame, by: str, rsd: float = SKETCH_RSD) -> DataFrame:
    """Sketched number of distinct senders per group."""
    return f.groupBy(by).agg(F.approx_count_distinct("sender", rsd).alias("n_senders_approx"))


def histogram(f: DataFrame, col: str, lo: float, hi: float, n: int) -> DataFrame:
    """Equal-width bins 1 to ``n``; 0 and ``n + 1`` take what lies outside."""
    bin_no = F.width_bucket(F.col(col).cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(n))
    return f.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n_flows"))


def spread_stats(f: DataFrame, by: str) -> DataFrame:
    """Deviation of quantity and value and their correlation."""
    qty, value = F.col("qty").cast("double"), F.col("value").cast("double")
    return f.groupBy(by).agg(
        F.round(F.stddev(qty), 6).alias("sd_qty"),
        F.round(F.variance(qty), 6).alias("var_qty"),
        F.round(F.stddev(value), 4).alias("sd_value"),
        F.round(F.corr(qty, value), 6).alias("qty_value_corr"),
    )
