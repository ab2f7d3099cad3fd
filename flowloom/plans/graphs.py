"""Graph queries: nations joined by flows, and senders joined to receivers."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions import money
from flowloom.operators import flows as fl
from flowloom.operators import graph, iterate
from flowloom.operators import windows as win
from flowloom.operators.lineage import cut
from flowloom.plans.registry import EDGES, PLAIN_FLOWS, TRADE, query, strong, with_sql
from flowloom.sources import scan


def _plain(spark, sf_dir):
    return fl.flow_facts(fl.tables(spark, sf_dir), asset=False)


def _nations(spark, sf_dir):
    return graph.edges(_plain(spark, sf_dir))


def _trade(spark, sf_dir):
    return graph.trade_edges(_plain(spark, sf_dir))


NATIONS_SQL = (PLAIN_FLOWS, EDGES)
TRADE_SQL = (PLAIN_FLOWS, TRADE)
MAIN_PARTNERS = 0.15

# Receivers that follow each other in the flows of a sender: a graph with triangles that
# grows with the data.
HANDOVER = """edges AS MATERIALIZED (
  SELECT src, receiver AS dst, CAST(count(*) AS DECIMAL(38,4)) AS weight FROM (
    SELECT receiver, lag(receiver) OVER (PARTITION BY sender ORDER BY ts, receiver) AS src
    FROM (SELECT DISTINCT sender, ts, receiver FROM flows))
  WHERE src <> receiver GROUP BY ALL)"""
HANDOVER_SQL = (PLAIN_FLOWS, HANDOVER)


def _handovers(spark, sf_dir):
    return graph.handovers(_plain(spark, sf_dir))


@query("edges", with_sql(*NATIONS_SQL, select="SELECT * FROM edges"))
def edges(spark, sf_dir):
    return _nations(spark, sf_dir)


@query(
    "strong_edges",
    with_sql(*TRADE_SQL, strong(MAIN_PARTNERS), select="SELECT * FROM strong"),
)
def strong_edges(spark, sf_dir):
    return graph.strong_edges(_trade(spark, sf_dir), MAIN_PARTNERS)


@query(
    "degrees",
    with_sql(
        *TRADE_SQL,
        select="""SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree,
                 CAST(sum(ow) AS DECIMAL(38,4)) AS out_weight,
                 CAST(sum(iw) AS DECIMAL(38,4)) AS in_weight
          FROM (SELECT src AS node, 1 AS o, 0 AS i, weight AS ow, 0 AS iw FROM edges
                UNION ALL SELECT dst, 0, 1, 0, weight FROM edges) GROUP BY node""",
    ),
)
def degrees(spark, sf_dir):
    return graph.degrees(_trade(spark, sf_dir))


@query(
    "net_flow",
    with_sql(
        *NATIONS_SQL,
        select="""SELECT least(src, dst) AS a, greatest(src, dst) AS b,
                 CAST(sum(CASE WHEN src < dst THEN weight ELSE 0 END) AS DECIMAL(38,4)) AS forward,
                 CAST(sum(CASE WHEN src > dst THEN weight ELSE 0 END) AS DECIMAL(38,4)) AS backward,
                 CAST(sum(CASE WHEN src < dst THEN weight ELSE -weight END) AS DECIMAL(38,4)) AS net
          FROM edges WHERE src <> dst GROUP BY 1, 2""",
    ),
)
def net_flow(spark, sf_dir):
    return graph.net_flow(_nations(spark, sf_dir))


@query(
    "reciprocity",
    with_sql(
        *NATIONS_SQL,
        select="""SELECT count(*) AS n_edges, count(r.src) AS n_mutual,
                 round(count(r.src) / nullif(count(*), 0), 6) AS reciprocity
          FROM edges e LEFT JOIN edges r ON r.src = e.dst AND r.dst = e.src
          WHERE e.src <> e.dst""",
    ),
)
def reciprocity(spark, sf_dir):
    return graph.reciprocity(_nations(spark, sf_dir))


@query(
    "graph_stats",
    with_sql(
        *TRADE_SQL,
        """stats AS (SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges))
               AS n_nodes, count(*) AS n_edges, count(*) FILTER (src = dst) AS n_self_loops
             FROM edges)""",
        select="""SELECT *, round(CAST(n_edges - n_self_loops AS DOUBLE)
                 / nullif(n_nodes * (n_nodes - 1), 0), 6) AS density FROM stats""",
    ),
)
def graph_stats(spark, sf_dir):
    return graph.graph_stats(_trade(spark, sf_dir))


# ---- searches and components -----------------------------------------------

TOP_SENDER = """seed AS (SELECT sender * 2 AS node FROM flows GROUP BY sender
  ORDER BY sum(value) DESC, sender LIMIT 1)"""

BOTH_WAYS = """near AS MATERIALIZED (
  SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM (SELECT src AS a, dst AS b FROM {0})
  WHERE a <> b),
sym AS MATERIALIZED (SELECT x AS src, y AS dst FROM near UNION ALL SELECT y, x FROM near)"""


BFS = """bfs(node, level) USING KEY (node) AS (
  SELECT node, 0 FROM seed
  UNION
  SELECT dst, min(level) + 1 FROM bfs JOIN sym ON src = node
  WHERE NOT EXISTS (FROM recurring.bfs r WHERE r.node = dst){0} GROUP BY dst)"""


def _top_sender(trade):
    sent = trade.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("v"))
    return win.top_k(sent, [F.col("v").desc(), F.col("node").asc()], 1).select("node")


@query(
    "k_hop",
    with_sql(*TRADE_SQL, TOP_SENDER, BOTH_WAYS.format("edges"), BFS.format(" AND level < 3"),
             select="SELECT node, level FROM bfs", recursive=True),
)
def k_hop(spark, sf_dir):
    trade = cut(_trade(spark, sf_dir))
    return iterate.k_hop(iterate.both_directions(trade), _top_sender(trade), 3)


@query(
    "bfs_levels",
    with_sql(*TRADE_SQL, TOP_SENDER, BOTH_WAYS.format("edges"), BFS.format(""),
             select="SELECT node, level FROM bfs", recursive=True),
)
def bfs_levels(spark, sf_dir):
    trade = cut(_trade(spark, sf_dir))
    return iterate.bfs_levels(iterate.both_directions(trade), _top_sender(trade))


COMPONENTS = """parts(node, component) USING KEY (node) AS (
  SELECT DISTINCT node, node FROM (SELECT unnest([src, dst]) AS node FROM edges)
  UNION
  SELECT dst, min(p.component) FROM parts p JOIN sym ON src = p.node
  JOIN recurring.parts r ON r.node = dst GROUP BY dst, r.component
  HAVING min(p.component) < r.component)"""


@query(
    "connected_components",
    with_sql(*HANDOVER_SQL, BOTH_WAYS.format("edges"), COMPONENTS,
             select="SELECT node, component FROM parts", recursive=True),
)
def connected_components(spark, sf_dir):
    return iterate.connected_components(_handovers(spark, sf_dir))


@query(
    "connected_components_all",
    with_sql(*TRADE_SQL, BOTH_WAYS.format("edges"), COMPONENTS,
             select="SELECT node, component FROM parts", recursive=True),
)
def connected_components_all(spark, sf_dir):
    return iterate.connected_components(_trade(spark, sf_dir))


# ---- rankings --------------------------------------------------------------


def _pagerank_sql(rounds: int, d: float = 0.85) -> list[str]:
    steps = [
        """share AS MATERIALIZED (SELECT src, dst, CAST(weight AS DOUBLE)
             / sum(CAST(weight AS DOUBLE)) OVER (PARTITION BY src) AS share FROM edges)""",
        "nodes AS MATERIALIZED (SELECT src AS node FROM edges UNION SELECT dst FROM edges)",
        "idle AS MATERIALIZED (SELECT node FROM nodes WHERE node NOT IN (SELECT src FROM edges))",
        "size AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes)",
        "r0 AS MATERIALIZED (SELECT node, 1 / n AS rank FROM nodes, size)",
    ]
    for i in range(1, rounds + 1):
        steps.append(
            f"""r{i} AS MATERIALIZED (SELECT node, {1 - d} / n + {d} * (coalesce(got, 0)
                  + coalesce((SELECT sum(rank) FROM r{i - 1} JOIN idle USING (node)), 0) / n) AS rank
                FROM nodes JOIN size ON true LEFT JOIN (
                  SELECT dst, sum(rank * share) AS got FROM share JOIN r{i - 1} ON node = src
                  GROUP BY dst) ON dst = node)"""
        )
    return steps


@query(
    "pagerank_nations",
    with_sql(*NATIONS_SQL, *_pagerank_sql(10), select="SELECT node, round(rank, 8) AS rank FROM r10"),
)
def pagerank_nations(spark, sf_dir):
    ranks = iterate.pagerank(_nations(spark, sf_dir), rounds=10)
    return ranks.select("node", F.round("rank", 8).alias("rank"))


@query(
    "pagerank_trade",
    with_sql(*TRADE_SQL, *_pagerank_sql(5), select="SELECT node, round(rank, 10) AS rank FROM r5"),
)
def pagerank_trade(spark, sf_dir):
    ranks = iterate.pagerank(_trade(spark, sf_dir), rounds=5)
    return ranks.select("node", F.round("rank", 10).alias("rank"))


def _hits_sql(rounds: int) -> list[str]:
    steps = [
        "nodes AS MATERIALIZED (SELECT src AS node FROM edges UNION SELECT dst FROM edges)",
        "h0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS hub, 0.0::DOUBLE AS authority FROM nodes)",
    ]
    for i in range(1, rounds + 1):
        steps += [
            f"""a{i} AS MATERIALIZED (SELECT dst AS node, sum(hub) AS s FROM edges
                  JOIN h{i - 1} ON node = src GROUP BY dst)""",
            f"""b{i} AS MATERIALIZED (SELECT src AS node, sum(s) AS s FROM edges
                  JOIN a{i} ON node = dst GROUP BY src)""",
            f"""h{i} AS MATERIALIZED (SELECT node,
                  coalesce(b.s, 0) / (SELECT sum(s) FROM b{i}) AS hub,
                  coalesce(a.s, 0) / (SELECT sum(s) FROM a{i}) AS authority
                FROM nodes LEFT JOIN a{i} a USING (node) LEFT JOIN b{i} b USING (node))""",
        ]
    return steps


@query(
    "hits",
    with_sql(*TRADE_SQL, *_hits_sql(5),
             select="SELECT node, round(hub, 10) AS hub, round(authority, 10) AS authority FROM h5"),
)
def hits(spark, sf_dir):
    scores = iterate.hits(_trade(spark, sf_dir), rounds=5)
    return scores.select(
        "node", F.round("hub", 10).alias("hub"), F.round("authority", 10).alias("authority")
    )


# ---- triangles, cores, communities -----------------------------------------

PAIRS = """pairs AS MATERIALIZED (
  SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {0} WHERE src <> dst)"""

TRIANGLES = """triangles AS MATERIALIZED (
  SELECT x.a AS p, x.b AS q, y.b AS r FROM pairs x JOIN pairs y ON y.a = x.b
  JOIN pairs z ON z.a = x.a AND z.b = y.b)"""


@query(
    "triangle_count",
    with_sql(*HANDOVER_SQL, PAIRS.format("edges"), TRIANGLES,
             select="SELECT count(*) AS n_triangles FROM triangles"),
)
def triangle_count(spark, sf_dir):
    return graph.triangle_count(_handovers(spark, sf_dir))


@query(
    "triangle_count_all",
    with_sql(*NATIONS_SQL, PAIRS.format("edges"), TRIANGLES,
             select="SELECT count(*) AS n_triangles FROM triangles"),
)
def triangle_count_all(spark, sf_dir):
    return graph.triangle_count(_nations(spark, sf_dir))


@query(
    "clustering",
    with_sql(
        *HANDOVER_SQL,
        PAIRS.format("edges"),
        TRIANGLES,
        select="""SELECT node, degree, coalesce(t, 0) AS triangles,
                 CASE WHEN degree < 2 THEN 0.0
                      ELSE round(2 * coalesce(t, 0) / (degree * (degree - 1)), 6) END AS clustering
          FROM (SELECT node, count(*) AS degree FROM (SELECT unnest([a, b]) AS node FROM pairs)
                GROUP BY node)
          LEFT JOIN (SELECT node, count(*) AS t FROM (SELECT unnest([p, q, r]) AS node
                     FROM triangles) GROUP BY node) USING (node)""",
    ),
)
def clustering(spark, sf_dir):
    return graph.clustering(_handovers(spark, sf_dir))


BOTH_ENDS = "ends AS MATERIALIZED (SELECT a AS src, b AS dst FROM pairs UNION ALL SELECT b, a FROM pairs)"

# Peeling: edges whose ends have fewer than k edges left go until none does.
K_CORE = """peel AS (
  SELECT 0 AS step, src, dst, NULL::BIGINT AS degree, true AS low FROM ends
  UNION ALL
  SELECT step + 1, src, dst, degree, bool_or(degree < {k}) OVER () FROM (
    SELECT step, src, dst, count(*) OVER (PARTITION BY src) AS degree FROM (
      SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY src) AS s, count(*) OVER (PARTITION BY dst) AS d FROM peel)
      WHERE low AND s >= {k} AND d >= {k})))"""


@query(
    "k_core",
    with_sql(
        *TRADE_SQL,
        PAIRS.format("edges"),
        BOTH_ENDS,
        K_CORE.format(k=30),
        select="SELECT DISTINCT src AS node, degree AS core_degree FROM peel WHERE NOT low",
        recursive=True,
    ),
)
def k_core(spark, sf_dir):
    return iterate.k_core(_trade(spark, sf_dir), 30)


# All cores: where nothing is left to peel at k, whatever is there has core number k.
ALL_CORES = """peel AS (
  SELECT 1 AS k, src, dst FROM ends
  UNION ALL
  SELECT CASE WHEN low THEN k ELSE k + 1 END, src, dst FROM (
    SELECT *, bool_or(s < k OR d < k) OVER () AS low FROM (
      SELECT *, count(*) OVER (PARTITION BY src) AS s, count(*) OVER (PARTITION BY dst) AS d FROM peel))
  WHERE s >= k AND d >= k)"""


@query(
    "core_numbers",
    with_sql(
        *TRADE_SQL,
        PAIRS.format("edges"),
        BOTH_ENDS,
        ALL_CORES,
        select="SELECT src AS node, CAST(max(k) - 1 AS BIGINT) AS core FROM peel GROUP BY src",
        recursive=True,
    ),
)
def core_numbers(spark, sf_dir):
    return iterate.core_numbers(_trade(spark, sf_dir)).drop("round")


def _labels_sql(rounds: int) -> list[str]:
    steps = [
        BOTH_WAYS.format("edges"),
        "s0 AS MATERIALIZED (SELECT DISTINCT unnest([src, dst]) AS node, node AS label FROM edges)",
    ]
    for i in range(1, rounds + 1):
        steps.append(
            f"""s{i} AS MATERIALIZED (SELECT node, label FROM (
                  SELECT dst AS node, label, count(*) AS votes FROM s{i - 1} JOIN sym ON src = node
                  GROUP BY dst, label
                  UNION ALL SELECT node, node, 0 FROM s0)
                QUALIFY row_number() OVER (PARTITION BY node ORDER BY votes DESC, label) = 1)"""
        )
    return steps


@query(
    "label_propagation",
    with_sql(*TRADE_SQL, *_labels_sql(5), select="SELECT node, label FROM s5"),
)
def label_propagation(spark, sf_dir):
    return iterate.label_propagation(_trade(spark, sf_dir), rounds=5)


# ---- bipartite, sequences, charts ------------------------------------------

LINKS = "links AS MATERIALIZED (SELECT DISTINCT sender, receiver FROM flows)"


@query(
    "projection_strength",
    with_sql(
        PLAIN_FLOWS,
        LINKS,
        select="""SELECT receiver, count(*) AS n_senders,
                 count(*) FILTER (reach > 1) AS n_shared_senders,
                 CAST(sum(reach - 1) AS BIGINT) AS strength
          FROM links JOIN (SELECT sender, count(*) AS reach FROM links GROUP BY sender)
            USING (sender) GROUP BY receiver""",
    ),
)
def projection_strength(spark, sf_dir):
    return graph.projection_strength(_plain(spark, sf_dir))


@query(
    "shared_senders_of_rank_neighbours",
    with_sql(
        PLAIN_FLOWS,
        LINKS,
        """earned AS (SELECT dst, receiver, CAST(sum(value) AS DECIMAL(38,4)) AS total_value
          FROM flows GROUP BY ALL)""",
        """wanted AS (SELECT lag(receiver) OVER (PARTITION BY dst ORDER BY total_value, receiver) AS a,
             receiver AS b FROM earned QUALIFY a IS NOT NULL)""",
        select="""SELECT a, b, count(y.sender) AS n_shared FROM wanted
          LEFT JOIN links x ON x.receiver = a
          LEFT JOIN links y ON y.receiver = b AND y.sender = x.sender GROUP BY a, b""",
    ),
)
def shared_senders_of_rank_neighbours(spark, sf_dir):
    dealt = cut(
        _plain(spark, sf_dir)
        .groupBy("dst", "receiver", "sender")
        .agg(money(F.sum("value")).alias("value"))
    )
    earned = dealt.groupBy("dst", "receiver").agg(money(F.sum("value")).alias("total_value"))
    pairs = graph.next_in_rank(earned, "dst", "total_value", "receiver")
    return graph.shared_senders(dealt, pairs)


@query(
    "transitions",
    """WITH steps AS (
         SELECT src, dst, count(*) AS n_steps FROM (
           SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src,
                  event_type AS dst FROM events) WHERE src IS NOT NULL GROUP BY ALL)
       SELECT src, dst, n_steps,
              round(n_steps / sum(n_steps) OVER (PARTITION BY src), 6) AS probability FROM steps""",
)
def transitions(spark, sf_dir):
    return graph.transitions(scan(spark, sf_dir, "events"))


@query(
    "sankey_links",
    with_sql(
        *TRADE_SQL,
        """sources AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS source_id
          FROM (SELECT DISTINCT src FROM edges))""",
        """targets AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1
             + (SELECT count(*) FROM sources) AS target_id FROM (SELECT DISTINCT dst FROM edges))""",
        select="""SELECT source_id, target_id, src, dst, weight FROM edges
          JOIN sources USING (src) JOIN targets USING (dst)""",
    ),
)
def sankey_links(spark, sf_dir):
    return graph.sankey_links(_trade(spark, sf_dir))
