"""Time series, rankings and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions import fixed, money
from flowloom.operators import flows as fl
from flowloom.operators import windows as win
from flowloom.plans.registry import FLOWS, PLAIN_FLOWS, query, with_sql
from flowloom.sources import scan

TOTALS = "count(*) AS n_flows, CAST(sum(value) AS DECIMAL(38,4)) AS total_value"


def _resampled(unit: str, by: str = "src, ") -> str:
    return f"""resampled AS (SELECT {by}date_trunc('{unit}', ts) AS period, {TOTALS}
      FROM flows GROUP BY ALL)"""


FILLED = """filled AS (
  SELECT s.src, CAST(d.period AS TIMESTAMP) AS period, coalesce(n_flows, 0) AS n_flows,
         coalesce(total_value, 0) AS total_value
  FROM (SELECT DISTINCT src FROM resampled) s
  JOIN (SELECT unnest(generate_series((SELECT min(period) FROM resampled),
               (SELECT max(period) FROM resampled), INTERVAL 1 DAY)) AS period) d ON true
  LEFT JOIN resampled r ON r.src = s.src AND r.period = d.period)"""


def _plain(spark, sf_dir):
    return fl.flow_facts(fl.tables(spark, sf_dir), asset=False)


def _daily(spark, sf_dir):
    return win.fill_gaps(win.resample(_plain(spark, sf_dir), "day", ["src"]), ["src"])


def _monthly(spark, sf_dir):
    return win.resample(_plain(spark, sf_dir), "month", ["src"])


@query(
    "resample_monthly",
    with_sql(PLAIN_FLOWS, _resampled("month", ""), select="SELECT * FROM resampled"),
)
def resample_monthly(spark, sf_dir):
    return win.resample(_plain(spark, sf_dir), "month")


@query(
    "fill_gaps",
    with_sql(PLAIN_FLOWS, _resampled("day"), FILLED, select="SELECT * FROM filled"),
)
def fill_gaps(spark, sf_dir):
    return _daily(spark, sf_dir)


@query(
    "period_change",
    with_sql(
        PLAIN_FLOWS,
        _resampled("month"),
        select="""SELECT src, period, total_value,
                 CAST(total_value - before AS DECIMAL(38,4)) AS change,
                 round(CAST(total_value AS DOUBLE) / nullif(CAST(before AS DOUBLE), 0), 6) AS growth
          FROM (SELECT *, lag(total_value) OVER (PARTITION BY src ORDER BY period) AS before
                FROM resampled)""",
    ),
)
def period_change(spark, sf_dir):
    return win.period_change(_monthly(spark, sf_dir), ["src"])


@query(
    "rolling_7_days",
    with_sql(
        PLAIN_FLOWS,
        _resampled("day"),
        FILLED,
        select="""SELECT src, period, CAST(sum(n_flows) OVER w AS BIGINT) AS n_rolling,
                 CAST(sum(total_value) OVER w AS DECIMAL(38,4)) AS value_rolling
          FROM filled
          WINDOW w AS (PARTITION BY src ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    ),
)
def rolling_7_days(spark, sf_dir):
    return win.rolling(_daily(spark, sf_dir), ["src"], 7)


@query(
    "rolling_6_hours",
    """SELECT event_id, user_id, ts, count(*) OVER w AS n_rolling,
              CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DECIMAL(38,2)) AS value_rolling
       FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts
                    RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)""",
)
def rolling_6_hours(spark, sf_dir):
    events = scan(spark, sf_dir, "events", ["event_id", "user_id", "ts", "value"])
    return win.rolling_time(
        events, "user_id", "6 HOURS", fixed(F.col("value"), 2)
    ).select(
        "event_id",
        "user_id",
        "ts",
        "n_rolling",
        F.col("value_rolling").cast("decimal(38,2)").alias("value_rolling"),
    )


@query(
    "running_total",
    with_sql(
        PLAIN_FLOWS,
        _resampled("month"),
        select="""SELECT src, period, CAST(sum(total_value) OVER (PARTITION BY src ORDER BY period
                 ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,4)) AS value_so_far FROM resampled""",
    ),
)
def running_total(spark, sf_dir):
    return win.running_total(_monthly(spark, sf_dir), ["src"])


@query(
    "time_bucket_6h",
    """SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS bucket_start, count(*) AS n_events,
              CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_value
       FROM events GROUP BY ALL""",
)
def time_bucket_6h(spark, sf_dir):
    return win.time_bucket(scan(spark, sf_dir, "events"), "6 hours", ["event_type"])


def _routes(spark, sf_dir):
    return (
        _plain(spark, sf_dir).groupBy("src", "dst").agg(money(F.sum("value")).alias("total_value"))
    )


ROUTES = """routes AS (SELECT src, dst, CAST(sum(value) AS DECIMAL(38,4)) AS total_value
  FROM flows GROUP BY ALL)"""


@query(
    "top_receivers_per_source",
    with_sql(
        PLAIN_FLOWS,
        """paid AS (SELECT src, receiver, CAST(sum(value) AS DECIMAL(38,4)) AS total_value
          FROM flows GROUP BY ALL)""",
        select="""SELECT src, receiver, total_value, CAST(row_number() OVER (PARTITION BY src
                 ORDER BY total_value DESC NULLS LAST, receiver NULLS FIRST) AS INTEGER) AS place
          FROM paid QUALIFY place <= 5""",
    ),
)
def top_receivers_per_source(spark, sf_dir):
    paid = (
        _plain(spark, sf_dir)
        .groupBy("src", "receiver")
        .agg(money(F.sum("value")).alias("total_value"))
    )
    order = [F.col("total_value").desc_nulls_last(), F.col("receiver").asc_nulls_first()]
    return win.top_n(paid, ["src"], order, 5)


@query(
    "rank_largest_quantities",
    with_sql(
        PLAIN_FLOWS,
        select="""SELECT src, receiver, qty, CAST(dense_rank() OVER (PARTITION BY src
                 ORDER BY qty DESC NULLS LAST) AS INTEGER) AS place
          FROM flows QUALIFY place <= 2""",
    ),
)
def rank_largest_quantities(spark, sf_dir):
    f = _plain(spark, sf_dir).select("src", "receiver", "qty")
    return win.top_ranks(f, ["src"], "qty", 2, dense=True)


@query(
    "rank_many_order_totals",
    """SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(rank() OVER (PARTITION BY o_orderpriority
         ORDER BY o_totalprice DESC NULLS LAST) AS INTEGER) AS place
       FROM orders QUALIFY place <= 2000""",
)
def rank_many_order_totals(spark, sf_dir):
    """A top list of more rows a group than Spark cuts before the shuffle."""
    orders = scan(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return win.top_ranks(orders, ["o_orderpriority"], "o_totalprice", 2000)


@query(
    "share_of_source",
    with_sql(
        PLAIN_FLOWS,
        ROUTES,
        select="""SELECT *, round(CAST(total_value AS DOUBLE) / nullif(CAST(sum(total_value)
                 OVER (PARTITION BY src) AS DOUBLE), 0), 6) AS share FROM routes""",
    ),
)
def share_of_source(spark, sf_dir):
    return win.share(_routes(spark, sf_dir), ["src"])


@query(
    "concentration",
    with_sql(
        PLAIN_FLOWS,
        ROUTES,
        select="""SELECT src, round(sum(share * share), 6) AS concentration
          FROM (SELECT src, CAST(total_value AS DOUBLE) / nullif(CAST(sum(total_value)
                OVER (PARTITION BY src) AS DOUBLE), 0) AS share FROM routes) GROUP BY src""",
    ),
)
def concentration(spark, sf_dir):
    return win.concentration(_routes(spark, sf_dir), ["src"])


@query(
    "sender_distribution",
    with_sql(
        PLAIN_FLOWS,
        """sent AS (SELECT src, sender, CAST(sum(value) AS DECIMAL(38,4)) AS total_value
          FROM flows GROUP BY ALL)""",
        select="""SELECT src, sender, total_value,
                 CAST(ntile(4) OVER (PARTITION BY src ORDER BY total_value NULLS FIRST, sender)
                      AS INTEGER) AS tile,
                 round(percent_rank() OVER v, 9) AS percent_rank,
                 round(cume_dist() OVER v, 9) AS cume_dist
          FROM sent WINDOW v AS (PARTITION BY src ORDER BY total_value NULLS FIRST)""",
    ),
)
def sender_distribution(spark, sf_dir):
    sent = (
        _plain(spark, sf_dir)
        .groupBy("src", "sender")
        .agg(money(F.sum("value")).alias("total_value"))
    )
    return win.distribution(sent, "src", "total_value", "sender", 4)


@query(
    "top_assets_plus_other",
    with_sql(
        FLOWS,
        """moved AS (SELECT src, asset, CAST(sum(value) AS DECIMAL(38,4)) AS total_value,
             row_number() OVER (PARTITION BY src ORDER BY sum(value) DESC NULLS LAST,
                                asset NULLS FIRST) AS place
           FROM flows GROUP BY src, asset)""",
        select="""SELECT src, CASE WHEN place <= 3 THEN asset ELSE 'OTHER' END AS asset,
                 CAST(sum(total_value) AS DECIMAL(38,4)) AS total_value
          FROM moved GROUP BY ALL""",
    ),
)
def top_assets_plus_other(spark, sf_dir):
    moved = (
        fl.flow_facts(fl.tables(spark, sf_dir))
        .groupBy("src", "asset")
        .agg(money(F.sum("value")).alias("total_value"))
    )
    return win.top_n_plus_other(moved, ["src"], "asset", 3)


@query(
    "top_senders",
    with_sql(
        PLAIN_FLOWS,
        select=f"""SELECT sender, {TOTALS} FROM flows GROUP BY sender
          ORDER BY total_value DESC NULLS LAST, sender LIMIT 20""",
    ),
)
def top_senders(spark, sf_dir):
    sent = (
        _plain(spark, sf_dir)
        .groupBy("sender")
        .agg(F.count(F.lit(1)).alias("n_flows"), money(F.sum("value")).alias("total_value"))
    )
    return win.top_k(sent, [F.col("total_value").desc_nulls_last(), F.col("sender").asc()], 20)
