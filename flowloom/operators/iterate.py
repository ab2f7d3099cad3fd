"""Graph algorithms that run in rounds.

The driver keeps a few numbers per round, never rows.  Each round ends in a
table on shared storage, which keeps the plan the same size in every round and
bounds what a lost executor costs.  A loop ends when nothing changes any more
and raises if that takes more rounds than allowed.

The edges do not change between rounds, so their hot keys are found and salted
once and they are written in buckets by salted key.  A vertex table is broadcast
to the edges while its counted rows are below ``BROADCAST_ROWS``; beyond that it
is shuffled to the buckets, and the edges stay where they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.graph import undirected
from flowloom.operators import spread
from flowloom.operators.lineage import Levels, Rounds, bucketed, cut
from flowloom.operators.spread import (
    BROADCAST_ROWS,
    MAX_HOT,
    copy_rows,
    fits_one_task,
    hot_keys,
    join_spread,
    salt_rows,
)


class NotConverged(RuntimeError):
    """The allowed number of rounds was not enough."""


@dataclass
class Adjacency:
    """Edges kept ready for repeated joins on one of their ends."""

    key: str
    rows: DataFrame
    hot: DataFrame | None
    #: Whether any key has more rows than one task should take.
    crowded: bool = False

    @classmethod
    def of(
        cls, e: DataFrame, key: str, rows_per_task: int | None = None, ready: bool = False
    ) -> Adjacency:
        """``ready`` says that ``e`` is cheap to read again, as rows of a written table are."""
        e = e if ready else cut(e)
        n = e.count()
        if fits_one_task(n, rows_per_task):
            return cls(key, cut(e), None)
        hot = cut(hot_keys(e, [key], rows_per_task, total=n).select(key, "_parts"))
        limit = max(rows_per_task or spread.ROWS_PER_TASK, n / MAX_HOT)
        buckets = max(e.sparkSession.sparkContext.defaultParallelism, math.ceil(n / limit))
        # Written with their salts, so that the loop does not make them again.
        rows = bucketed(salt_rows(e, [key], hot), [key, "_salt"], buckets)
        return cls(key, rows, hot, not hot.isEmpty())

    def join(self, nodes: DataFrame, n_nodes: int) -> DataFrame:
        """Edges with the columns of ``nodes``, which has the key column of this end."""
        if n_nodes <= BROADCAST_ROWS:
            nodes = F.broadcast(nodes)
        elif self.hot is not None:
            copies = copy_rows(nodes, [self.key], self.hot)
            return self.rows.join(copies, [self.key, "_salt"]).drop("_salt")
        return self.rows.join(nodes, self.key).drop("_salt")


def _nodes(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def both_directions(e: DataFrame) -> DataFrame:
    """Every undirected pair as two edges; no self-loops, no parallel edges."""
    return _two_ways(undirected(e))


def _two_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
            )
        ).alias("x")
    ).select("x.src", "x.dst")


def bfs_levels(
    e: DataFrame,
    seeds: DataFrame,
    max_rounds: int | None = None,
    give_up: int = 10_000,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Least number of steps along the edges from any seed to each vertex reached.

    ``max_rounds`` is the greatest level wanted; without it the search goes on
    until no new vertex turns up.
    """
    out = Adjacency.of(e.select("src", "dst").filter("src <> dst"), "src", rows_per_task)
    # A round writes its new vertices next to those of the rounds before.
    levels = Levels(e.sparkSession, "node " + e.schema["src"].dataType.simpleString() + ", level int")
    n_new = levels.append(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    level = 0
    while n_new and (max_rounds is None or level < max_rounds):
        if level == give_up:
            raise NotConverged(f"vertices still turn up after {give_up} rounds")
        front = levels.rows(level).select(F.col("node").alias("src"))
        level += 1
        reached = out.join(front, n_new).select(F.col("dst").alias("node")).distinct()
        n_new = levels.append(
            reached.join(levels.rows(), "node", "left_anti").withColumn("level", F.lit(level))
        )
    return levels.rows()


def k_hop(
    e: DataFrame, seeds: DataFrame, k: int, rows_per_task: int | None = None
) -> DataFrame:
    """Vertices within ``k`` steps of a seed, with their level."""
    return bfs_levels(e, seeds, max_rounds=k, rows_per_task=rows_per_task)


def _pull_to_least(e: DataFrame, rows_per_task: int | None, total: int) -> DataFrame:
    """``(src, dst, least)``: every edge with the least neighbour of its source."""
    least = e.groupBy("src").agg(F.min("dst").alias("least"), F.count(F.lit(1)).alias("_rows"))
    if fits_one_task(total, rows_per_task):
        return e.join(least.drop("_rows"), "src")
    hot = hot_keys(least, ["src"], rows_per_task, counted=True, total=total)
    return join_spread(e, least.drop("_rows"), "src", hot=hot)


def connected_components(
    e: DataFrame, give_up: int = 200, rows_per_task: int | None = None
) -> DataFrame:
    """Least vertex of the component of each vertex, by alternating star operations.

    A round first links the larger neighbours of each vertex to its least
    neighbour, then the vertex and its smaller neighbours to the least of them.
    The graph ends up as one star per component, and does so in far fewer
    rounds than its diameter: paths shrink by half each time.
    """
    e = cut(e.select("src", "dst"))
    nodes = _nodes(e)
    state, half = Rounds(), Rounds()
    # Links point from the greater vertex to the smaller one.
    links = state.step(
        e.filter("src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct(),
        n=F.count(F.lit(1)),
    )
    # Neither star operation adds links, so the first count holds as a bound.
    n_links = state.facts["n"]
    for _ in range(give_up):
        sym = links.select(
            F.explode(
                F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
            ).alias("x")
        ).select("x.src", "x.dst")
        large = (
            _pull_to_least(sym, rows_per_task, 2 * n_links)
            .filter("dst > src")
            .select(F.col("dst").alias("src"), F.least("src", "least").alias("dst"))
            .distinct()
        )
        if not fits_one_task(n_links, rows_per_task):
            large = half.step(large)
        to_least = F.array(
            F.struct(F.col("dst").alias("src"), F.col("least").alias("dst")),
            F.struct(F.col("src"), F.col("least").alias("dst")),
        )
        links = state.step(
            _pull_to_least(large, rows_per_task, n_links)
            .select(F.explode(to_least).alias("x"))
            .select("x.src", "x.dst")
            .filter("src <> dst")
            .distinct()
        )
        ends = links.select(
            F.explode(
                F.array(
                    F.struct(F.col("src").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("hub")),
                    F.struct(F.col("dst").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("hub")),
                )
            ).alias("x")
        )
        not_star = (
            ends.groupBy("x.node")
            .agg(F.sum("x.leaf").alias("leaf"), F.max("x.hub").alias("hub"))
            .filter("leaf > 1 OR (leaf = 1 AND hub = 1)")
        )
        if not_star.isEmpty():
            half.drop(e.sparkSession)
            own = nodes.select("node", F.col("node").alias("component"))
            linked = links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
            return own.unionByName(linked).groupBy("node").agg(F.min("component").alias("component"))
    raise NotConverged(f"components still change after {give_up} rounds")


def pagerank(
    e: DataFrame,
    damping: float = 0.85,
    rounds: int = 10,
    rows_per_task: int | None = None,
    tol: float | None = None,
) -> DataFrame:
    """Weighted PageRank.

    The rank of vertices without outgoing weight is shared out evenly.  With
    ``tol`` the loop ends when the ranks change by less in sum, and raises if
    ``rounds`` do not suffice; without, it takes exactly ``rounds``.
    """
    e = cut(e.select("src", "dst", "weight"))
    weight = F.col("weight").cast("double")
    sent = e.groupBy("src").agg(F.sum(weight).alias("_sent"), F.count(F.lit(1)).alias("_rows"))
    sent = sent.filter("_sent > 0")
    n_edges = e.count()
    hot = hot_keys(sent, ["src"], rows_per_task, counted=True, total=n_edges)
    shares = join_spread(
        e, sent.drop("_rows"), "src", rows_per_task=rows_per_task, hot=hot, total=n_edges
    ).select(
        "src", "dst", (weight / F.col("_sent")).alias("share")
    )
    out = Adjacency.of(shares, "src", rows_per_task)
    # A vertex row carries whether it sends anything, so that the mass of those
    # that do not is one sum per round.
    state, known = Rounds(), Rounds()
    nodes = known.step(
        e.select(
            F.explode(
                F.array(
                    F.struct(F.col("src").alias("node"), weight.alias("w")),
                    F.struct(F.col("dst").alias("node"), F.lit(0.0).alias("w")),
                )
            ).alias("x")
        )
        .groupBy("x.node")
        .agg((F.sum("x.w") > 0).alias("sends")),
        n=F.count(F.lit(1)),
        idle=F.count_if(~F.col("sends")),
    )
    n, n_idle = known.facts["n"], known.facts["idle"]
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    idle = n_idle / n
    for _ in range(rounds):
        received = out.join(
            ranks.filter("sends").select(F.col("node").alias("src"), "rank"), n
        ).select(
            F.col("dst").alias("node"),
            (F.col("rank") * F.col("share")).alias("got"),
            F.lit(None).cast("boolean").alias("sends"),
        )
        was = F.lit(0.0) if tol is None else F.col("rank")
        base = ranks.select("node", F.lit(0.0).alias("got"), "sends", was.alias("was"))
        ranks = state.step(
            received.withColumn("was", F.lit(0.0))
            .unionByName(base)
            .groupBy("node")
            .agg(
                F.max("sends").alias("sends"),
                ((1 - damping) / n + damping * (F.sum("got") + idle / n)).alias("rank"),
                F.sum("was").alias("was"),
            ),
            idle=F.sum(F.when(F.col("sends"), 0.0).otherwise(F.col("rank"))),
            moved=F.sum(F.abs(F.col("rank") - F.col("was"))),
        )
        idle = state.facts["idle"]
        if tol is not None and state.facts["moved"] < tol:
            break
    else:
        if tol is not None:
            raise NotConverged(f"ranks still change after {rounds} rounds")
    return ranks.select("node", "rank")


def k_core(
    e: DataFrame, k: int, give_up: int = 10_000, rows_per_task: int | None = None
) -> DataFrame:
    """Vertices of the largest subgraph in which all have degree ``k`` or more.

    Each round removes every vertex below ``k`` at once.
    """
    left, counted = Rounds(), Rounds()
    pairs = left.step(undirected(e).select("a", "b"), n=F.count(F.lit(1)))
    for _ in range(give_up):
        degree = counted.step(
            pairs.select(F.explode(F.array("a", "b")).alias("node"))
            .groupBy("node")
            .agg(F.count(F.lit(1)).alias("core_degree")),
            low=F.count_if(F.col("core_degree") < k),
        )
        low = degree.filter(F.col("core_degree") < k).select("node")
        n_low = counted.facts["low"]
        if n_low == 0:
            return degree
        for end in ("a", "b"):
            if n_low <= BROADCAST_ROWS:
                gone = F.broadcast(low.withColumnRenamed("node", end))
                pairs = pairs.join(gone, end, "left_anti")
            else:
                stay = degree.filter(F.col("core_degree") >= k).select(F.col("node").alias(end))
                pairs = join_spread(
                    pairs, stay, end, rows_per_task=rows_per_task, total=left.facts["n"]
                )
        pairs = left.step(pairs, n=F.count(F.lit(1)))
    raise NotConverged(f"vertices still drop out after {give_up} rounds")


def _hanging(pairs: DataFrame, degree: DataFrame, rows_per_task: int | None) -> DataFrame:
    """Vertices of the chains that end in a leaf, whole chains at once.

    A chain is a component of vertices of degree one and two.
    """
    thin = cut(degree.filter("d <= 2"))
    inside = pairs
    for end in ("a", "b"):
        inside = inside.join(thin.select(F.col("node").alias(end)), end, "left_semi")
    links = inside.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    alone = thin.filter("d = 1").select(F.col("node").alias("src"), F.col("node").alias("dst"))
    chains = connected_components(links.unionByName(alone), rows_per_task=rows_per_task)
    ends = (
        chains.join(thin, "node").filter("d = 1").select("component").distinct()
    )
    return cut(chains.join(ends, "component", "left_semi").select("node"))


def core_numbers(
    e: DataFrame, give_up: int = 10_000, rows_per_task: int | None = None
) -> DataFrame:
    """The core number of each vertex of the undirected graph: the largest ``k`` with a k-core that holds it.

    Every vertex starts from its degree and takes, round by round, the h-index of its
    neighbours' values: the largest ``h`` such that ``h`` of them have ``h`` or more.  Values only
    fall and settle at the core numbers, of all ``k`` at once; a vertex is computed
    again only if a neighbour has fallen.  Neighbours count up to the value of the
    vertex itself, so a hub is a count for each value and no list of neighbours.

    Chains that end in a leaf would fall by one vertex a round.  They have core number 1 and
    are taken off whole beforehand, until no leaf is left.

    ``round`` is the round in which a vertex took its value, 0 if it kept its degree.
    """
    undone = cut(undirected(e).select("a", "b"))
    all_nodes = cut(undone.select(F.explode(F.array("a", "b")).alias("node")).distinct())

    def degrees(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        return cut(ends.groupBy("node").agg(F.count(F.lit(1)).alias("d")))

    degree = degrees(undone)
    for _ in range(give_up):
        if degree.filter("d = 1").isEmpty():
            break
        gone = _hanging(undone, degree, rows_per_task)
        for end in ("a", "b"):
            undone = undone.join(gone.select(F.col("node").alias(end)), end, "left_anti")
        undone = cut(undone)
        degree = degrees(undone)
    near = Adjacency.of(_two_ways(undone), "src", rows_per_task, ready=True)
    n = degree.count()
    state, due_state = Rounds(), Rounds()
    values = state.step(
        degree.select("node", F.col("d").alias("core"), F.lit(0).alias("round")), n=F.count(F.lit(1))
    )
    fallen = n
    for number in range(1, give_up + 1):
        if not fallen:
            break
        due = values
        if number > 1:
            changed = values.filter(F.col("round") == number - 1).select(F.col("node").alias("src"))
            again = near.join(changed, fallen).select(F.col("dst").alias("node")).distinct()
            due = due_state.step(values.join(again, "node", "left_semi"), n=F.count(F.lit(1)))
        n_due = due_state.facts["n"] if number > 1 else n
        # Seen from the other end every edge tells the value of its source.
        wanted = due.select("node", "core")
        few = n_due <= BROADCAST_ROWS
        edges = near
        if few:
            edges = replace(near, rows=near.rows.join(F.broadcast(wanted.withColumnRenamed("node", "dst")), "dst"))
        told = edges.join(values.select(F.col("node").alias("src"), F.col("core").alias("told")), n)
        told = told.select(F.col("dst").alias("node"), "told", *(["core"] if few else []))
        if near.crowded:
            # Counted on both sides of the shuffle, as a hub hears more than a task should take.
            told = told.groupBy(*told.columns).agg(F.count(F.lit(1)).alias("n"))
        else:
            # One shuffle by vertex serves the join and both groupings.
            told = told.repartition("node")
        if not few:
            told = told.join(wanted, "node")
        several = F.sum("n") if "n" in told.columns else F.count(F.lit(1))
        counted = told.groupBy("node", F.least("told", "core").alias("told"), "core").agg(several.alias("n"))
        # The counts from the top down: the h-index is the best of min(value, neighbours so far).
        steps = F.reverse(F.sort_array(F.collect_list(F.struct("told", "n"))))
        best = F.aggregate(
            steps,
            F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(0).cast("bigint").alias("h")),
            lambda x, y: F.struct(
                (x["seen"] + y["n"]).alias("seen"),
                F.greatest(x["h"], F.least(y["told"], x["seen"] + y["n"])).alias("h"),
            ),
            lambda x: x["h"],
        )
        new = counted.groupBy("node").agg(best.alias("h"))
        lower = F.col("h") < F.col("core")
        values = state.step(
            values.join(new, "node", "left").select(
                "node",
                F.when(lower, F.col("h")).otherwise(F.col("core")).alias("core"),
                F.when(lower, F.lit(number)).otherwise(F.col("round")).alias("round"),
            ),
            fallen=F.count_if(F.col("round") == number),
        )
        fallen = state.facts["fallen"]
    else:
        raise NotConverged(f"core numbers still fall after {give_up} rounds")
    settled = all_nodes.join(values, "node", "left")
    return settled.select(
        "node",
        F.coalesce("core", F.lit(1)).cast("bigint").alias("core"),
        F.coalesce("round", F.lit(0)).alias("round"),
    )


def label_propagation(
    e: DataFrame, rounds: int = 5, rows_per_task: int | None = None
) -> DataFrame:
    """Labels after a fixed number of synchronous rounds on the undirected graph.

    A vertex takes the most frequent label among its neighbours, the smallest
    of those that tie.  Vertices without neighbours keep their own.
    """
    e = cut(e.select("src", "dst", "weight"))
    pairs = cut(undirected(e).select("a", "b"))
    near = Adjacency.of(_two_ways(pairs), "src", rows_per_task, ready=True)
    nodes = cut(_nodes(e))
    state = Rounds()
    n = nodes.count()
    labels = nodes.withColumn("label", F.col("node"))
    for _ in range(rounds):
        told = near.join(labels.withColumnRenamed("node", "src"), n).select(
            F.col("dst").alias("node"), "label"
        )
        if not near.crowded:
            # One shuffle by vertex serves both groupings.  A hub that hears more than a task
            # should take is counted by label on both sides of a shuffle first.
            told = told.repartition("node")
        votes = told.groupBy("node", "label").agg(F.count(F.lit(1)).alias("votes"))
        own = nodes.select("node", F.col("node").alias("label"), F.lit(0).cast("bigint").alias("votes"))
        first = F.struct((-F.col("votes")).alias("fewer"), "label")
        best = votes.groupBy("node").agg(F.min_by(F.struct("label", "votes"), first).alias("best"))
        labels = state.step(
            best.select("node", "best.*")
            .unionByName(own)
            .groupBy("node")
            .agg(F.min_by("label", first).alias("label"))
        )
    return labels


def hits(
    e: DataFrame,
    rounds: int = 5,
    rows_per_task: int | None = None,
    tol: float | None = None,
) -> DataFrame:
    """Hub and authority scores, each summing to 1.

    With ``tol`` the loop ends when the hub scores change by less in sum, and
    raises if ``rounds`` do not suffice; without, it takes exactly ``rounds``.
    """
    pairs = cut(e.select("src", "dst").distinct())
    by_src = Adjacency.of(pairs, "src", rows_per_task)
    nodes = cut(_nodes(pairs))
    n = nodes.count()
    n_dst = pairs.select("dst").distinct().count()
    # Few receivers are broadcast to the edges by sender, whose sums then are complete in their buckets.
    by_dst = by_src if n_dst <= BROADCAST_ROWS else Adjacency.of(pairs, "dst", rows_per_task)
    state, half = Rounds(), Rounds()
    scores = nodes.select("node", F.lit(1.0).alias("hub"), F.lit(0.0).alias("authority"))
    hub_sum = authority_sum = 1.0

    def gather(edges: DataFrame, to: str, score: Column) -> DataFrame:
        return edges.groupBy(F.col(to).alias("node")).agg(F.sum(score).alias("score"))

    for _ in range(rounds):
        hubs = scores.select(F.col("node").alias("src"), (F.col("hub") / hub_sum).alias("s"))
        authority = half.step(gather(by_src.join(hubs, n), "dst", F.col("s")))
        received = authority.withColumnsRenamed({"node": "dst", "score": "s"})
        if n_dst <= BROADCAST_ROWS:
            sent_back = by_dst.rows.join(F.broadcast(received), "dst")
        else:
            sent_back = by_dst.join(received, n_dst)
        hub = gather(sent_back, "src", F.col("s"))
        zero = F.lit(0.0)
        was = zero if tol is None else F.col("hub") / hub_sum
        scores = state.step(
            scores.select("node", zero.alias("hub"), zero.alias("authority"), was.alias("was"))
            .unionByName(
                hub.select("node", F.col("score").alias("hub"), zero.alias("authority"), zero.alias("was"))
            )
            .unionByName(
                authority.select(
                    "node", zero.alias("hub"), F.col("score").alias("authority"), zero.alias("was")
                )
            )
            .groupBy("node")
            .agg(*[F.sum(c).alias(c) for c in ("hub", "authority", "was")]),
            hub=F.sum("hub"),
            authority=F.sum("authority"),
        )
        hub_sum, authority_sum = (state.facts[s] or 1.0 for s in ("hub", "authority"))
        if tol is not None:
            moved = scores.agg(F.sum(F.abs(F.col("hub") / hub_sum - F.col("was")))).first()[0]
            if (moved or 0.0) < tol:
                break
    else:
        if tol is not None:
            raise NotConverged(f"scores still change after {rounds} rounds")
    return scores.select(
        "node",
        (F.col("hub") / hub_sum).alias("hub"),
        (F.col("authority") / authority_sum).alias("authority"),
    )
