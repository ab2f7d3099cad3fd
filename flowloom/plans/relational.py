"""Scans, projections, joins, aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions import fixed, money, period_start
from flowloom.operators import aggregates as agg
from flowloom.operators import flows as fl
from flowloom.operators import joins, sets
from flowloom.operators.lineage import cut
from flowloom.plans.registry import FLOWS, PLAIN_FLOWS, query, with_sql
from flowloom.sources import read_partition, scan, scratch_path, sql, write_partitioned

TOTALS = "count(*) AS n_flows, CAST(sum(value) AS DECIMAL(38,4)) AS total_value"


def flows(spark, sf_dir, **kw):
    return fl.flow_facts(fl.tables(spark, sf_dir), **kw)


# ---- sources and sinks -----------------------------------------------------


@query(
    "scan_lineitem",
    """SELECT l_orderkey, l_suppkey, l_quantity, l_shipdate FROM lineitem
       WHERE l_quantity >= 45 AND l_returnflag = 'R'""",
)
def scan_lineitem(spark, sf_dir):
    return scan(
        spark,
        sf_dir,
        "lineitem",
        ["l_orderkey", "l_suppkey", "l_quantity", "l_shipdate"],
        (F.col("l_quantity") >= 45) & (F.col("l_returnflag") == "R"),
    )


@query(
    "sql_over_frames",
    """SELECT c_mktsegment, o_orderpriority, count(*) AS n_orders,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_price
       FROM orders JOIN customer ON c_custkey = o_custkey
       WHERE o_orderdate >= TIMESTAMP '1999-01-01 00:00:00'
       GROUP BY c_mktsegment, o_orderpriority""",
)
def sql_over_frames(spark, sf_dir):
    return sql(
        spark,
        """SELECT c_mktsegment, o_orderpriority, count(*) AS n_orders,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_price
           FROM {orders} JOIN {customer} ON c_custkey = o_custkey
           WHERE o_orderdate >= CAST(:since AS TIMESTAMP_NTZ)
           GROUP BY c_mktsegment, o_orderpriority""",
        args={"since": "1999-01-01"},
        orders=scan(spark, sf_dir, "orders"),
        customer=scan(spark, sf_dir, "customer"),
    )


@query(
    "partitioned_roundtrip",
    with_sql(
        PLAIN_FLOWS,
        select=f"""SELECT src, dst, {TOTALS} FROM flows WHERE year(ts) = 1999 GROUP BY src, dst""",
    ),
)
def partitioned_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "flows-by-year")
    f = flows(spark, sf_dir, asset=False).withColumn("year", F.year("ts"))
    write_partitioned(f.select("src", "dst", "value", "year"), path, ["year"])
    return (
        read_partition(spark, path, year=1999)
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n_flows"), money(F.sum("value")).alias("total_value"))
    )


# ---- projection, filter, scalar functions ----------------------------------


@query("flow_facts", with_sql(FLOWS, select="SELECT * FROM flows"))
def flow_facts(spark, sf_dir):
    return flows(spark, sf_dir)


@query(
    "filter_flows",
    with_sql(
        FLOWS,
        select="""SELECT * FROM flows
          WHERE ts >= TIMESTAMP '1998-01-01 00:00:00' AND ts < TIMESTAMP '1999-01-01 00:00:00'
            AND asset IN ('Brand#1', 'Brand#7', 'Brand#12') AND src IN (1, 2, 3, 5, 8)""",
    ),
)
def filter_flows(spark, sf_dir):
    return fl.filter_flows(
        flows(spark, sf_dir),
        "1998-01-01",
        "1999-01-01",
        assets=["Brand#1", "Brand#7", "Brand#12"],
        src=[1, 2, 3, 5, 8],
    )


@query(
    "enrich_flows",
    with_sql(
        FLOWS,
        select="""SELECT flows.*, a.n_name AS src_nation, ar.r_name AS src_region,
                 b.n_name AS dst_nation, br.r_name AS dst_region
          FROM flows
          JOIN nation a ON a.n_nationkey = src JOIN region ar ON ar.r_regionkey = a.n_regionkey
          JOIN nation b ON b.n_nationkey = dst JOIN region br ON br.r_regionkey = b.n_regionkey""",
    ),
)
def enrich_flows(spark, sf_dir):
    return fl.enrich(
        flows(spark, sf_dir), scan(spark, sf_dir, "nation"), scan(spark, sf_dir, "region")
    )


@query(
    "time_parts",
    with_sql(
        PLAIN_FLOWS,
        select=f"""SELECT CAST(year(ts) AS INTEGER) AS year, CAST(quarter(ts) AS INTEGER) AS quarter,
                 CAST(month(ts) AS INTEGER) AS month,
                 CAST(isodow(ts) - 1 AS INTEGER) AS weekday, {TOTALS}
          FROM flows GROUP BY ALL""",
    ),
)
def time_parts(spark, sf_dir):
    return (
        fl.with_time_parts(flows(spark, sf_dir, asset=False))
        .groupBy("year", "quarter", "month", "weekday")
        .agg(F.count(F.lit(1)).alias("n_flows"), money(F.sum("value")).alias("total_value"))
    )


@query(
    "route_label",
    with_sql(
        PLAIN_FLOWS,
        select=f"""SELECT lpad(CAST(src AS VARCHAR), 3, '0') || '>' || lpad(CAST(dst AS VARCHAR), 3, '0')
                   AS route, {TOTALS} FROM flows GROUP BY ALL""",
    ),
)
def route_label(spark, sf_dir):
    return (
        fl.with_route_label(flows(spark, sf_dir, asset=False))
        .groupBy("route")
        .agg(F.count(F.lit(1)).alias("n_flows"), money(F.sum("value")).alias("total_value"))
    )


@query(
    "value_band",
    with_sql(
        PLAIN_FLOWS,
        select=f"""SELECT src, CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN value < 10000 THEN 'SMALL'
                 WHEN value < 50000 THEN 'MEDIUM' ELSE 'LARGE' END AS band, {TOTALS}
          FROM flows GROUP BY ALL""",
    ),
)
def value_band(spark, sf_dir):
    return (
        fl.with_value_band(flows(spark, sf_dir, asset=False))
        .groupBy("src", "band")
        .agg(F.count(F.lit(1)).alias("n_flows"), money(F.sum("value")).alias("total_value"))
    )


@query(
    "json_field",
    """SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
              count(*) AS n_events
       FROM events GROUP BY ALL""",
)
def json_field(spark, sf_dir):
    events = scan(spark, sf_dir, "events", ["event_type", "props"])
    return (
        fl.with_json_field(events, "$.k", "int", "k")
        .groupBy("event_type", "k")
        .agg(F.count(F.lit(1)).alias("n_events"))
    )


@query(
    "assets_per_route",
    with_sql(
        FLOWS,
        select="""SELECT src, dst, count(DISTINCT asset) AS n_assets,
                 array_to_string(list_sort(list(DISTINCT asset)), ',') AS assets
          FROM flows GROUP BY src, dst""",
    ),
)
def assets_per_route(spark, sf_dir):
    """The arrays as text, with their lengths."""
    return fl.assets_per_route(flows(spark, sf_dir)).select(
        "src",
        "dst",
        F.size("assets").cast("bigint").alias("n_assets"),
        F.concat_ws(",", "assets").alias("assets"),
    )


@query(
    "dedup_latest",
    with_sql(
        FLOWS,
        select="""SELECT * FROM flows
          QUALIFY row_number() OVER (PARTITION BY sender, receiver
                  ORDER BY ts DESC NULLS LAST, value DESC NULLS LAST, asset NULLS FIRST,
                           qty NULLS FIRST) = 1""",
    ),
)
def dedup_latest(spark, sf_dir):
    return fl.dedup(
        flows(spark, sf_dir),
        ["sender", "receiver"],
        [
            F.col("ts").desc_nulls_last(),
            F.col("value").desc_nulls_last(),
            F.col("asset").asc_nulls_first(),
            F.col("qty").asc_nulls_first(),
        ],
    )


# ---- joins -----------------------------------------------------------------


@query(
    "join_inner",
    """SELECT c_mktsegment, o_orderstatus, count(*) AS n_orders,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_price
       FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""",
)
def join_inner(spark, sf_dir):
    orders = scan(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return (
        joins.equi_join(orders, scan(spark, sf_dir, "customer"), "c_custkey")
        .groupBy("c_mktsegment", "o_orderstatus")
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.sum(fixed(F.col("o_totalprice"), 2)).cast("decimal(38,2)").alias("total_price"),
        )
    )


@query(
    "join_left",
    """SELECT c_custkey, c_nationkey, coalesce(n, 0) AS n_orders, last_order
       FROM customer LEFT JOIN (
         SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_order FROM orders
         WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' GROUP BY o_custkey)
       ON o_custkey = c_custkey""",
)
def join_left(spark, sf_dir):
    recent = F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")
    orders = (
        scan(spark, sf_dir, "orders", pred=recent)
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last_order"))
    )
    customer = scan(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    return joins.equi_join(customer, orders, "c_custkey", "left").select(
        "c_custkey", "c_nationkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order"
    )


def _first_half_of_2001(spark, sf_dir):
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2001-01-01", "2001-07-01"))
    period = (F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end)
    return scan(spark, sf_dir, "orders", [F.col("o_custkey").alias("c_custkey")], period)


PERIOD = """(SELECT o_custkey FROM orders
   WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00'
     AND o_orderdate < TIMESTAMP '2001-07-01 00:00:00')"""


@query(
    "semi_active_senders",
    f"SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_custkey IN {PERIOD}",
)
def semi_active_senders(spark, sf_dir):
    who = scan(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    return joins.active(who, _first_half_of_2001(spark, sf_dir), "c_custkey")


@query(
    "anti_inactive_senders",
    f"SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_custkey NOT IN {PERIOD}",
)
def anti_inactive_senders(spark, sf_dir):
    who = scan(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    return joins.inactive(who, _first_half_of_2001(spark, sf_dir), "c_custkey")


@query(
    "full_outer_both_ways",
    with_sql(
        PLAIN_FLOWS,
        """months AS MATERIALIZED (
          SELECT src, dst, date_trunc('month', ts)::TIMESTAMP AS month,
                 CAST(sum(value) AS DECIMAL(38,4)) AS weight FROM flows GROUP BY ALL)""",
        select="""SELECT coalesce(f.src, r.dst) AS a, coalesce(f.dst, r.src) AS b,
                 coalesce(f.month, r.month) AS month,
                 coalesce(f.weight, 0) AS forward, coalesce(r.weight, 0) AS backward
          FROM (SELECT * FROM months WHERE src < dst) f
          FULL JOIN (SELECT * FROM months WHERE src > dst) r
            ON f.src = r.dst AND f.dst = r.src AND f.month = r.month""",
    ),
)
def full_outer_both_ways(spark, sf_dir):
    month = period_start(F.col("ts"), "month").alias("month")
    months = (
        flows(spark, sf_dir, asset=False)
        .groupBy("src", "dst", month)
        .agg(money(F.sum("value")).alias("weight"))
    )
    return joins.both_ways(months, ["month"])


@query(
    "asof_last_click",
    """SELECT p.event_id, p.user_id, p.ts, c.ts AS prev_ts, c.event_id AS prev_event_id,
              c.value AS prev_value
       FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
       ON p.user_id = c.user_id AND p.ts > c.ts""",
)
def asof_last_click(spark, sf_dir):
    events = scan(spark, sf_dir, "events")
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.filter("event_type = 'click'").select("user_id", "ts", "event_id", "value")
    return joins.asof(purchases, clicks, "user_id", "ts", "event_id")


@query(
    "band_clicks_before_purchase",
    """SELECT p.event_id, p.user_id, p.ts, count(c.event_id) AS n_in_band,
              CAST(sum(CAST(c.value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_in_band
       FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
         ON c.user_id = p.user_id AND c.ts >= p.ts - INTERVAL 12 HOUR AND c.ts < p.ts
       GROUP BY p.event_id, p.user_id, p.ts""",
)
def band_clicks_before_purchase(spark, sf_dir):
    events = scan(spark, sf_dir, "events")
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.filter("event_type = 'click'").select("user_id", "ts", "value")
    return joins.band_totals(
        purchases, clicks, "user_id", "ts", "12 HOURS", fixed(F.col("value"), 2)
    ).withColumn("sum_in_band", F.col("sum_in_band").cast("decimal(38,2)"))


# ---- aggregation -----------------------------------------------------------


@query(
    "route_summary",
    with_sql(
        FLOWS,
        select=f"""SELECT src, dst, {TOTALS},
                 round(CAST(sum(value) AS DOUBLE) / count(value), 4) AS mean_value,
                 min(value) AS min_value, max(value) AS max_value,
                 count(DISTINCT asset) AS n_assets
          FROM flows GROUP BY src, dst""",
    ),
)
def route_summary(spark, sf_dir):
    return agg.route_summary(flows(spark, sf_dir))


@query(
    "rollup_region_nation",
    with_sql(
        PLAIN_FLOWS,
        select=f"""SELECT r_name AS src_region, n_name AS src_nation,
                 CAST(grouping(r_name) AS INTEGER) AS all_src_region,
                 CAST(grouping(n_name) AS INTEGER) AS all_src_nation, {TOTALS}
          FROM flows JOIN nation ON n_nationkey = src JOIN region ON r_regionkey = n_regionkey
          GROUP BY ROLLUP (r_name, n_name)""",
    ),
)
def rollup_region_nation(spark, sf_dir):
    named = fl.enrich(
        flows(spark, sf_dir, asset=False), scan(spark, sf_dir, "nation"), scan(spark, sf_dir, "region")
    )
    return agg.rolled_up(named, ["src_region", "src_nation"])


@query(
    "cube_flag_brand",
    f"""SELECT l_returnflag, p_brand, CAST(grouping(l_returnflag) AS INTEGER) AS all_l_returnflag,
               CAST(grouping(p_brand) AS INTEGER) AS all_p_brand, count(*) AS n_flows,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,4)) AS total_value
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY CUBE (l_returnflag, p_brand)""",
)
def cube_flag_brand(spark, sf_dir):
    line = scan(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"),
        "l_returnflag",
        fixed(F.col("l_extendedprice"), 2).alias("value"),
    )
    part = scan(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    return agg.cubed(line.join(part, "p_partkey"), ["l_returnflag", "p_brand"])


@query(
    "grouping_sets",
    with_sql(
        FLOWS,
        select=f"""SELECT src, dst, asset, CAST(grouping(src) AS INTEGER) AS all_src,
                 CAST(grouping(dst) AS INTEGER) AS all_dst,
                 CAST(grouping(asset) AS INTEGER) AS all_asset, {TOTALS}
          FROM flows GROUP BY GROUPING SETS ((src, dst), (asset), ())""",
    ),
)
def grouping_sets(spark, sf_dir):
    return agg.grouped_by_sets(
        flows(spark, sf_dir), [["src", "dst"], ["asset"], []], ["src", "dst", "asset"]
    )


def _matrix(spark, sf_dir):
    places = scan(spark, sf_dir, "nation", ["n_nationkey"])
    return agg.route_matrix(flows(spark, sf_dir, asset=False), agg.listed(places, "n_nationkey"))


# The places of ``nation``, which is the same at every scale; SQL needs them spelled out.
PLACES = range(25)
ELSEWHERE = "dst IS NULL OR dst NOT IN (SELECT n_nationkey FROM nation)"


@query(
    "route_matrix",
    with_sql(
        PLAIN_FLOWS,
        select="SELECT src, "
        + ", ".join(f"count(*) FILTER (dst = {p}) AS to_{p}" for p in PLACES)
        + f", count(*) FILTER ({ELSEWHERE}) AS to_other FROM flows GROUP BY src",
    ),
)
def route_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(
    "melt_matrix",
    with_sql(
        PLAIN_FLOWS,
        select=f"""SELECT src, 'to_' || n_nationkey AS route, coalesce(n, 0) AS n_flows
          FROM (SELECT DISTINCT src FROM flows) JOIN nation ON true
          LEFT JOIN (SELECT src AS s, dst, count(*) AS n FROM flows GROUP BY ALL)
            ON s = src AND dst = n_nationkey
          UNION ALL SELECT src, 'to_other', count(*) FILTER ({ELSEWHERE}) FROM flows GROUP BY src""",
    ),
)
def melt_matrix(spark, sf_dir):
    return agg.melt(_matrix(spark, sf_dir), ["src"], "route", "n_flows")


@query(
    "quantiles",
    "SELECT event_type, "
    + ", ".join(
        f"round(quantile_cont(value, {p}), 6) AS q{round(p * 100)}"
        for p in (0.0, 0.25, 0.5, 0.75, 1.0)
    )
    + " FROM events GROUP BY event_type",
)
def quantiles(spark, sf_dir):
    events = scan(spark, sf_dir, "events", ["event_type", "value"])
    return agg.quantiles(events, "event_type", "value", (0.0, 0.25, 0.5, 0.75, 1.0))


@query(
    "distinct_senders",
    with_sql(
        PLAIN_FLOWS,
        select="SELECT dst, count(DISTINCT sender) AS n_senders FROM flows GROUP BY dst",
    ),
)
def distinct_senders(spark, sf_dir):
    return agg.distinct_senders(flows(spark, sf_dir, asset=False), "dst")


@query(
    "approx_distinct_senders",
    with_sql(
        PLAIN_FLOWS,
        select="""SELECT dst, count(DISTINCT sender) AS n_senders, true AS within_bound
          FROM flows GROUP BY dst""",
    ),
)
def approx_distinct_senders(spark, sf_dir):
    """The exact number, and whether the sketch is within four times its standard error."""
    dealt = cut(flows(spark, sf_dir, asset=False).select("dst", "sender"))
    exact = agg.distinct_senders(dealt, "dst")
    near = agg.approx_distinct_senders(dealt, "dst")
    off = F.abs(F.col("n_senders_approx") - F.col("n_senders"))
    return exact.join(near, "dst").select(
        "dst", "n_senders", (off <= 4 * agg.SKETCH_RSD * F.col("n_senders")).alias("within_bound")
    )


@query(
    "value_histogram",
    with_sql(
        PLAIN_FLOWS,
        select="""SELECT CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 100000 THEN 11
                 ELSE floor(10 * CAST(value AS DOUBLE) / 100000) + 1 END AS BIGINT) AS bin,
                 count(*) AS n_flows
          FROM flows GROUP BY ALL""",
    ),
)
def value_histogram(spark, sf_dir):
    return agg.histogram(flows(spark, sf_dir, asset=False), "value", 0, 100_000, 10)


@query(
    "spread_stats",
    with_sql(
        PLAIN_FLOWS,
        select="""SELECT src, round(stddev_samp(CAST(qty AS DOUBLE)), 6) AS sd_qty,
                 round(var_samp(CAST(qty AS DOUBLE)), 6) AS var_qty,
                 round(stddev_samp(CAST(value AS DOUBLE)), 4) AS sd_value,
                 round(corr(CAST(qty AS DOUBLE), CAST(value AS DOUBLE)), 6) AS qty_value_corr
          FROM flows GROUP BY src""",
    ),
)
def spread_stats(spark, sf_dir):
    return agg.spread_stats(flows(spark, sf_dir, asset=False), "src")


# ---- set operations --------------------------------------------------------


def _senders_of(spark, sf_dir, year):
    start, end = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (year, year + 1))
    period = (F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end)
    return scan(spark, sf_dir, "orders", [F.col("o_custkey").alias("sender")], period)


def _years(select: str) -> str:
    def year(y):
        return f"""(SELECT o_custkey AS sender FROM orders
          WHERE o_orderdate >= TIMESTAMP '{y}-01-01 00:00:00'
            AND o_orderdate < TIMESTAMP '{y + 1}-01-01 00:00:00')"""

    return f"WITH a AS {year(1999)}, b AS {year(2000)} {select}"


@query("union_all_senders", _years("SELECT sender FROM a UNION ALL SELECT sender FROM b"))
def union_all_senders(spark, sf_dir):
    return sets.union_all(_senders_of(spark, sf_dir, 1999), _senders_of(spark, sf_dir, 2000))


@query("union_senders", _years("SELECT sender FROM a UNION SELECT sender FROM b"))
def union_senders(spark, sf_dir):
    return sets.union_distinct(_senders_of(spark, sf_dir, 1999), _senders_of(spark, sf_dir, 2000))


@query("intersect_senders", _years("SELECT sender FROM a INTERSECT SELECT sender FROM b"))
def intersect_senders(spark, sf_dir):
    return sets.kept(_senders_of(spark, sf_dir, 1999), _senders_of(spark, sf_dir, 2000))


@query("except_senders", _years("SELECT sender FROM a EXCEPT SELECT sender FROM b"))
def except_senders(spark, sf_dir):
    return sets.lost(_senders_of(spark, sf_dir, 1999), _senders_of(spark, sf_dir, 2000))


@query(
    "sender_turnover",
    _years(
        """SELECT sender, CASE WHEN max(p) = 1 THEN 'lost' WHEN min(p) = 2 THEN 'new'
                          ELSE 'kept' END AS status
           FROM (SELECT sender, 1 AS p FROM a UNION ALL SELECT sender, 2 FROM b)
           GROUP BY sender"""
    ),
)
def sender_turnover(spark, sf_dir):
    return sets.turnover(_senders_of(spark, sf_dir, 1999), _senders_of(spark, sf_dir, 2000))


@query(
    "intersect_all_senders", _years("SELECT sender FROM a INTERSECT ALL SELECT sender FROM b")
)
def intersect_all_senders(spark, sf_dir):
    return sets.intersect_all(_senders_of(spark, sf_dir, 1999), _senders_of(spark, sf_dir, 2000))


@query("except_all_senders", _years("SELECT sender FROM a EXCEPT ALL SELECT sender FROM b"))
def except_all_senders(spark, sf_dir):
    return sets.except_all(_senders_of(spark, sf_dir, 1999), _senders_of(spark, sf_dir, 2000))
