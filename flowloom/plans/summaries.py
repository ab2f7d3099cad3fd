"""Queries over mergeable sketches, held against exact results.

The registered rows are the exact figures and whether the sketches agree with them
within their stated error, which SQL can say as well.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import aggregates as agg
from flowloom.operators import flows as fl
from flowloom.operators import sketches as sk
from flowloom.operators.lineage import cut
from flowloom.plans.registry import PLAIN_FLOWS, query, with_sql
from flowloom.sources import scan

PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


@query(
    "sketched_quantiles",
    "SELECT event_type, "
    + ", ".join(f"round(quantile_cont(value, {p}), 6) AS q{round(p * 100)}" for p in PROBS)
    + ", true AS within_bound FROM events GROUP BY event_type",
)
def sketched_quantiles(spark, sf_dir):
    """Quantiles of all days merged from a table of daily sketches, next to the exact ones."""
    events = scan(spark, sf_dir, "events", ["event_type", "ts", "value"])
    daily = cut(sk.quantile_sketches(events, ["event_type", F.to_date("ts").alias("day")], "value"))
    merged = cut(sk.merge_quantiles(daily, ["event_type"]))
    off = sk.rank_off(events, sk.sketched_quantiles(merged, PROBS), "event_type", "value", PROBS)
    near = off.select("event_type", (F.col("rank_off") <= sk.RANK_MARGIN * sk.rank_error()).alias("within_bound"))
    return agg.quantiles(events, "event_type", "value", PROBS).join(near, "event_type")


def _monthly(spark, sf_dir):
    """Senders with the year of each flow, and a written table of one sketch per month."""
    dealt = cut(
        fl.flow_facts(fl.tables(spark, sf_dir), asset=False).select(
            "sender", F.year("ts").alias("year"), F.month("ts").alias("month")
        )
    )
    return dealt, cut(sk.set_sketches(dealt, ["year", "month"], "sender"))


YEARS = "ys AS MATERIALIZED (SELECT DISTINCT CAST(year(ts) AS INTEGER) AS year, sender FROM flows)"


@query(
    "sketched_senders_per_year",
    with_sql(
        PLAIN_FLOWS,
        YEARS,
        select="SELECT year, count(*) AS n_senders, true AS within_bound FROM ys GROUP BY year",
    ),
)
def sketched_senders_per_year(spark, sf_dir):
    """Distinct senders of a year, and whether the union of its monthly sketches agrees."""
    dealt, months = _monthly(spark, sf_dir)
    exact = agg.distinct_senders(dealt, "year")
    off = F.abs(F.col("n_approx") - F.col("n_senders"))
    bound = sk.COUNT_MARGIN * sk.count_error() * F.col("n_senders")
    return exact.join(sk.merge_sets(months, ["year"]), "year").select(
        "year", "n_senders", (off <= bound).alias("within_bound")
    )


@query(
    "sketched_turnover",
    with_sql(
        PLAIN_FLOWS,
        YEARS,
        "n AS (SELECT year, count(*) AS n FROM ys GROUP BY year)",
        """k AS (SELECT a.year, count(*) AS kept FROM ys a JOIN ys b ON b.sender = a.sender AND b.year = a.year + 1
          GROUP BY a.year)""",
        select="""SELECT a.year, coalesce(kept, 0) AS n_kept, a.n - coalesce(kept, 0) AS n_lost,
                 b.n - coalesce(kept, 0) AS n_gained, true AS within_bound
          FROM n a JOIN n b ON b.year = a.year + 1 LEFT JOIN k ON k.year = a.year""",
    ),
)
def sketched_turnover(spark, sf_dir):
    """Senders kept, lost and gained from year to year, and whether set operations on sketches agree."""
    dealt, months = _monthly(spark, sf_dir)
    ys = cut(dealt.select("year", "sender").filter("sender IS NOT NULL").distinct())
    sizes = cut(ys.groupBy("year").agg(F.count(F.lit(1)).alias("n")))
    kept = (
        ys.join(ys.select((F.col("year") - 1).alias("year"), "sender"), ["year", "sender"])
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("kept"))
    )
    after = sizes.select((F.col("year") - 1).alias("year"), F.col("n").alias("n_after"))
    exact = sizes.join(after, "year").join(kept, "year", "left").select(
        "year",
        F.coalesce("kept", F.lit(0)).alias("n_kept"),
        (F.col("n") - F.coalesce("kept", F.lit(0))).alias("n_lost"),
        (F.col("n_after") - F.coalesce("kept", F.lit(0))).alias("n_gained"),
    )
    near = sk.turnover_of(cut(sk.merge_sets(months, ["year"])), "year")
    bound = sk.COUNT_MARGIN * sk.count_error() * F.col("n_union")
    agree = F.lit(True)
    for name in ("kept", "lost", "gained"):
        agree = agree & (F.abs(F.col(f"{name}_approx") - F.col(f"n_{name}")) <= bound)
    return exact.join(near, "year").select("year", "n_kept", "n_lost", "n_gained", agree.alias("within_bound"))
