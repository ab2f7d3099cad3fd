"""Graphs of flows: edge lists, degrees, balances, triangles, transitions.

Vertices are the ends of an edge frame ``(src, dst, weight)``.  ``edges`` sums
parallel edges, so every other operator may count on distinct pairs.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import money, ratio
from flowloom.operators.lineage import cut
from flowloom.operators.spread import fits_one_task, hot_keys, join_spread, running
from flowloom.operators.teams import packing, solving

# Triangles: neighbours of a vertex that a row holds at once, and entries of
# neighbour lists that a task reads.
SLICE = 32
ENTRIES_PER_TASK = 2_000_000
# Beyond one task's rows: edges that a team of three colours holds, about, and colours, of which
# few would leave few tasks.
TEAM_EDGES = 8_000_000
MIN_COLOURS = 6
MAX_COLOURS = 128
# Most tasks that teams are dealt to, and edges that are worth one.
MAX_TASKS = 2_000
MIN_EDGES = 10_000


def edges(f: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One weighted edge per ordered pair."""
    return f.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(
        money(F.sum("value")).alias("weight"), F.count(F.lit(1)).alias("n_flows")
    )


def trade_edges(f: DataFrame) -> DataFrame:
    """Sender to receiver edges, with both key ranges kept apart.

    Senders get the even numbers and receivers the odd ones.
    """
    return edges(
        f.select(
            (F.col("sender") * 2).alias("src"), (F.col("receiver") * 2 + 1).alias("dst"), "value"
        )
    )


def strong_edges(
    e: DataFrame, min_share: float, rows_per_task: int | None = None
) -> DataFrame:
    """Edges that carry at least ``min_share`` of what their source sends."""
    e = cut(e)
    sent = e.groupBy("src").agg(
        F.sum("weight").cast("double").alias("_sent"), F.count(F.lit(1)).alias("_rows")
    )
    n = e.count()
    hot = hot_keys(sent, ["src"], rows_per_task, counted=True, total=n)
    joined = join_spread(
        e, sent.drop("_rows"), "src", rows_per_task=rows_per_task, hot=hot, total=n
    )
    return joined.filter(F.col("weight").cast("double") >= F.col("_sent") * min_share).select(
        *e.columns
    )


def undirected(e: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b``; directions and weights fall together, self-loops go."""
    return (
        e.filter("src <> dst")
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(money(F.sum("weight")).alias("weight"))
    )


def degrees(e: DataFrame) -> DataFrame:
    """Edges and weight in and out of each vertex, in one aggregation."""
    ends = e.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("src").alias("node"),
                    F.lit(1).alias("o"),
                    F.lit(0).alias("i"),
                    F.col("weight").alias("ow"),
                    F.lit(0).cast(e.schema["weight"].dataType).alias("iw"),
                ),
                F.struct(
                    F.col("dst").alias("node"),
                    F.lit(0).alias("o"),
                    F.lit(1).alias("i"),
                    F.lit(0).cast(e.schema["weight"].dataType).alias("ow"),
                    F.col("weight").alias("iw"),
                ),
            )
        ).alias("end")
    )
    return ends.groupBy(F.col("end.node").alias("node")).agg(
        F.sum("end.o").alias("out_degree"),
        F.sum("end.i").alias("in_degree"),
        money(F.sum("end.ow")).alias("out_weight"),
        money(F.sum("end.iw")).alias("in_weight"),
    )


def net_flow(e: DataFrame) -> DataFrame:
    """What each unordered pair moves either way, and the balance, in one aggregation."""
    ahead = F.when(F.col("src") < F.col("dst"), F.col("weight")).otherwise(0)
    back = F.when(F.col("src") > F.col("dst"), F.col("weight")).otherwise(0)
    return (
        e.filter("src <> dst")
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(money(F.sum(ahead)).alias("forward"), money(F.sum(back)).alias("backward"))
        .withColumn("net", money(F.col("forward") - F.col("backward")))
    )


def reciprocity(e: DataFrame) -> DataFrame:
    """Share of directed edges, self-loops aside, whose reverse exists too."""
    pairs = (
        e.filter("src <> dst")
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    both = F.sum(F.when(F.col("n") == 2, 2).otherwise(0))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"),
        F.coalesce(both, F.lit(0)).alias("n_mutual"),
        ratio(both, F.sum("n")).alias("reciprocity"),
    )


def graph_stats(e: DataFrame) -> DataFrame:
    """Vertices, edges, self-loops and density (self-loops aside)."""
    per_node = e.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("src").alias("node"),
                    F.lit(1).alias("e"),
                    F.when(F.col("src") == F.col("dst"), 1).otherwise(0).alias("loop"),
                ),
                F.struct(F.col("dst").alias("node"), F.lit(0).alias("e"), F.lit(0).alias("loop")),
            )
        ).alias("end")
    )
    counted = per_node.groupBy("end.node").agg(
        F.sum("end.e").alias("e"), F.sum("end.loop").alias("loop")
    )
    n = F.col("n_nodes").cast("double")
    return counted.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("n_edges"),
        F.coalesce(F.sum("loop"), F.lit(0)).alias("n_self_loops"),
    ).withColumn(
        "density", ratio(F.col("n_edges") - F.col("n_self_loops"), n * (n - 1))
    )


def _common_neighbours(pairs: DataFrame, rows_per_task: int | None) -> DataFrame:
    """``(lo, hi, common)``: every triangle once, as a later vertex common to an edge.

    ``pairs`` holds the distinct pairs ``a < b`` as a written table.

    Edges point from the vertex of lower degree to the one of higher degree.  A
    vertex then has at most ``sqrt(2 * edges)`` successors, hubs included, so
    the successor lists are short enough to travel with an edge, and lists are
    intersected instead of forming all pairs of neighbours.
    """
    n = pairs.count()
    degree = cut(
        pairs.select(F.explode(F.array("a", "b")).alias("node"))
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("d"))
    )
    for end in ("a", "b"):
        named = degree.select(F.col("node").alias(end), F.col("d").alias(f"d_{end}"))
        pairs = join_spread(pairs, named, end, rows_per_task=rows_per_task, total=n)
    first = F.struct(F.col("d_a").alias("d"), F.col("a").alias("n"))
    second = F.struct(F.col("d_b").alias("d"), F.col("b").alias("n"))
    successors = (
        pairs.select(
            F.least(first, second)["n"].alias("lo"), F.greatest(first, second)["n"].alias("hi")
        )
        .groupBy("lo")
        .agg(F.collect_list("hi").alias("next"))
    )
    successors = cut(successors)
    far = successors.select(F.col("lo").alias("hi"), F.col("next").alias("far"))
    steps = _slices(successors).select("lo", "next", F.explode("part").alias("hi"))
    return join_spread(steps, far, "hi", rows_per_task=rows_per_task, total=n).select(
        "lo", "hi", F.array_intersect("next", "far").alias("common")
    )


def _slices(successors: DataFrame) -> DataFrame:
    """Successor lists with ``part``, up to ``SLICE`` of the list at a time, dealt out by work.

    The work of a list is to be read once for each of its own entries.  Lists are few
    bytes but much work, so tasks are counted in entries read, not in bytes.
    """
    length = F.size("next").cast("bigint")
    work = successors.agg(F.sum(length * length)).first()[0] or 0
    parts = F.expr(
        f"transform(sequence(0, CAST((size(next) - 1) DIV {SLICE} AS INT)), i -> slice(next, i * {SLICE} + 1, {SLICE}))"
    )
    return (
        successors.select("lo", "next", F.posexplode(parts).alias("number", "part"))
        .repartition(int(work // ENTRIES_PER_TASK) + 1, "lo", "number")
        .drop("number")
    )


def _largest_team(pairs: DataFrame, colours: int) -> int:
    """Edges of the team that has most, from one count for each pair of colours."""
    ends = [F.pmod(F.xxhash64(c), F.lit(colours)) for c in ("a", "b")]
    blocks = pairs.groupBy(F.least(*ends).alias("x"), F.greatest(*ends).alias("y")).count()
    n = Counter({(r["x"], r["y"]): r["count"] for r in blocks.collect()})
    teams = combinations_with_replacement(range(colours), 3)
    return max(sum(n[block] for block in {(x, y), (x, z), (y, z)}) for x, y, z in teams)


def _teams(pairs: DataFrame, n: int, rows_per_task: int | None, pack: bool = False) -> DataFrame:
    """``pairs`` in teams: every edge in each ``team`` that has both its colours, ``x <= y``.

    Vertices are coloured by hash and a team is three colours, equal ones among
    them.  All edges of a triangle meet in the team of its three colours.  An
    edge goes to as many teams as there are colours and a team has about
    ``6 / colours ** 2`` of the edges, so what is shuffled grows with the power 1.5 of
    the edges and neighbour lists do not travel at all.  Edges of a hub are in
    the teams of its colour; there are more colours where that fills a team.

    With ``pack`` edges are shuffled once, to the block of their two colours.  They are packed
    there, a byte or two for most of them, and it is packed blocks that go to the
    teams.  Rows of a team are then in one task and follow each other.
    """
    limit = rows_per_task or TEAM_EDGES
    colours = min(MAX_COLOURS, max(MIN_COLOURS, math.ceil(math.sqrt(6 * n / limit))))
    while colours < MAX_COLOURS and _largest_team(pairs, colours) > 4 * limit:
        colours = min(MAX_COLOURS, 2 * colours)
    x, y = (F.pmod(F.xxhash64(c), F.lit(colours)).cast("int") for c in ("a", "b"))
    ahead = F.col("x") <= F.col("y")
    rows = pairs.select("a", "b", x.alias("x"), y.alias("y")).select(
        F.least("x", "y").alias("x"),
        F.greatest("x", "y").alias("y"),
        F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("one"),
        F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("two"),
    )
    if pack:
        blocks = _tasks(math.comb(colours + 1, 2), n)
        rows = rows.repartitionById(blocks, F.expr("y * (y + 1) DIV 2 + x").cast("int"))
        rows = rows.mapInArrow(packing(), "x int, y int, edges binary")
    trio = F.sort_array(F.array("x", "y", "z"))
    p, q, r = (trio[k].cast("bigint") for k in range(3))
    # Numbers without gaps, so that tasks get equally many.
    number = r * (r + 1) * (r + 2) / 6 + q * (q + 1) / 2 + p
    dealt = rows.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(colours - 1)))).select(
        number.cast("int").alias("team"), *rows.columns[:2], "z", *rows.columns[2:]
    )
    if not pack:
        return dealt
    tasks = _tasks(math.comb(colours + 2, 3), n * colours)
    return dealt.repartitionById(tasks, F.col("team")).sortWithinPartitions("team")


def _tasks(most: int, rows: int) -> int:
    """Tasks for ``rows`` that fall into at most ``most`` groups."""
    return min(most, MAX_TASKS, rows // MIN_EDGES + 1)


def triangle_count(e: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Number of triangles of the undirected graph."""
    pairs = cut(undirected(e).select("a", "b"))
    n = pairs.count()
    if fits_one_task(n, rows_per_task):
        found = _common_neighbours(pairs, rows_per_task).select(F.size("common").alias("t"))
    else:
        found = _teams(pairs, n, rows_per_task, pack=True).mapInArrow(solving(False), "t bigint")
    return found.agg(F.coalesce(F.sum("t"), F.lit(0)).cast("bigint").alias("n_triangles"))


def _corners(pairs: DataFrame, rows_per_task: int | None) -> DataFrame:
    """``node`` and ``t``, triangles of the vertex; several rows may add up to them."""
    count = pairs.count()
    if not fits_one_task(count, rows_per_task):
        kind = pairs.schema["a"].dataType.simpleString()
        teams = _teams(pairs, count, rows_per_task, pack=True)
        return teams.mapInArrow(solving(True), f"node {kind}, t bigint")
    found = _common_neighbours(pairs, rows_per_task).filter(F.size("common") > 0)
    # Far corners one by one, then both ends of the edge with all its triangles.
    n = F.size("common").cast("bigint")
    return found.select(
        n.alias("n"), F.posexplode(F.concat("common", F.array("lo", "hi"))).alias("at", "node")
    ).select(
        "node",
        F.when(F.col("at") < F.col("n"), F.lit(1).cast("bigint")).otherwise(F.col("n")).alias("t"),
    )


def clustering(e: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Degree, triangles and local clustering of each vertex; 0 below degree two."""
    pairs = cut(undirected(e).select("a", "b"))
    triangles = _corners(pairs, rows_per_task).select(
        "node", F.lit(0).cast("bigint").alias("d"), "t"
    )
    degree = pairs.select(
        F.explode(F.array("a", "b")).alias("node"),
        F.lit(1).cast("bigint").alias("d"),
        F.lit(0).cast("bigint").alias("t"),
    )
    d, t = F.col("degree"), F.col("triangles")
    return (
        degree.unionByName(triangles)
        .groupBy("node")
        .agg(F.sum("d").alias("degree"), F.sum("t").alias("triangles"))
        .withColumn("clustering", F.coalesce(ratio(t * 2, d * (d - 1)), F.lit(0.0)))
    )


def handovers(f: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Receivers that follow each other in the flows of a sender, with how often they do.

    Flows of a sender go by time and, where that ties, by receiver.
    """
    stops = cut(f.select("sender", "ts", "receiver").distinct())
    return (
        running(
            stops,
            ["sender"],
            ["ts", "receiver"],
            lasts={"src": F.col("receiver")},
            inclusive=False,
            rows_per_task=rows_per_task,
            total=stops.count(),
        )
        .filter("src <> receiver AND sender IS NOT NULL")
        .groupBy("src", F.col("receiver").alias("dst"))
        .agg(money(F.count(F.lit(1))).alias("weight"))
    )


def projection_strength(bip: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Weighted degree of each receiver in the receiver-to-receiver projection.

    The projection joins receivers by the number of senders they share.  Its
    edges can outnumber any input (one sender to all receivers gives all
    pairs), but the weights at a receiver add up to the other receivers of its
    senders, which takes one count per sender.
    """
    links = cut(bip.select("sender", "receiver").distinct())
    reach = links.groupBy("sender").agg(F.count(F.lit(1)).alias("_rows"))
    n = links.count()
    hot = hot_keys(reach, ["sender"], rows_per_task, counted=True, total=n)
    joined = join_spread(
        links, reach, "sender", rows_per_task=rows_per_task, hot=hot, total=n
    )
    return joined.groupBy("receiver").agg(
        F.count(F.lit(1)).alias("n_senders"),
        F.sum(F.when(F.col("_rows") > 1, 1).otherwise(0)).alias("n_shared_senders"),
        F.sum(F.col("_rows") - 1).alias("strength"),
    )


def shared_senders(
    bip: DataFrame, pairs: DataFrame, rows_per_task: int | None = None
) -> DataFrame:
    """Weight in the projection of the given receiver pairs ``(a, b)``, 0 included."""
    links = cut(bip.select("sender", "receiver").distinct())
    pairs = cut(pairs.select("a", "b"))
    n = links.count()
    of_a = links.select("sender", F.col("receiver").alias("a"))
    of_b = links.select("sender", F.col("receiver").alias("b"), F.lit(1).alias("_hit"))
    wanted = join_spread(of_a, pairs, "a", rows_per_task=rows_per_task, total=n)
    hits = join_spread(wanted, of_b, ["b", "sender"], rows_per_task=rows_per_task)
    found = hits.select("a", "b", "_hit").unionByName(
        pairs.select("a", "b", F.lit(0).alias("_hit"))
    )
    return found.groupBy("a", "b").agg(F.sum("_hit").alias("n_shared"))


def next_in_rank(
    df: DataFrame, by: str, order: str, key: str, rows_per_task: int | None = None
) -> DataFrame:
    """Pairs ``(a, b)``: each row of a group and the row just before it in rank."""
    df = cut(df.select(by, order, key))
    seen = running(
        df,
        [by],
        [order, key],
        lasts={"_before": F.col(key)},
        inclusive=False,
        rows_per_task=rows_per_task,
        total=df.count(),
    )
    return seen.filter("_before IS NOT NULL").select(
        F.col("_before").alias("a"), F.col(key).alias("b")
    )


def transitions(
    events: DataFrame, by: str = "user_id", rows_per_task: int | None = None
) -> DataFrame:
    """Steps from one event type to the next of the same user, and their row shares."""
    seen = running(
        events.select(by, "ts", "event_id", "event_type"),
        [by],
        ["ts", "event_id"],
        lasts={"_from": F.struct("event_type")},
        inclusive=False,
        rows_per_task=rows_per_task,
    )
    steps = (
        seen.filter("_from IS NOT NULL")
        .groupBy(F.col("_from.event_type").alias("src"), F.col("event_type").alias("dst"))
        .agg(F.count(F.lit(1)).alias("n_steps"))
    )
    # Already one row per pair of event types.
    out = F.sum("n_steps").over(Window.partitionBy("src"))
    return steps.withColumn("probability", ratio(F.col("n_steps"), out))


def sankey_links(e: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Links between dense vertex ids: sources from 0, destinations after them."""
    e = cut(e)
    n = e.count()
    nodes = e.select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("layer"), F.col("src").alias("node")),
                F.struct(F.lit(1).alias("layer"), F.col("dst").alias("node")),
            )
        ).alias("n")
    ).select("n.layer", "n.node").distinct()
    numbered = cut(
        running(
            nodes,
            ["layer"],
            ["node"],
            sums={"_nr": F.lit(1)},
            rows_per_task=rows_per_task,
            total=2 * n,
        )
    )
    n_sources = numbered.filter("layer = 0").count()
    source = numbered.filter("layer = 0").select(
        F.col("node").alias("src"), (F.col("_nr") - 1).alias("source_id")
    )
    target = numbered.filter("layer = 1").select(
        F.col("node").alias("dst"), (F.col("_nr") - 1 + n_sources).alias("target_id")
    )
    links = join_spread(e, source, "src", rows_per_task=rows_per_task, total=n)
    links = join_spread(links, target, "dst", rows_per_task=rows_per_task, total=n)
    return links.select("source_id", "target_id", "src", "dst", "weight")
