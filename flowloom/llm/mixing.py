"""Mixing sources to target weights by a splitting tree, in DataFrame functions only.

Each source is laid out as one long row of words: its documents in the order of
a seeded hash, cut into blocks of ``BLOCK`` words.  A source's target turns into
an exact quota of blocks; a source that must be repeated is gone through
several times, and the last block drawn is shortened, so that the words taken
are the target rounded to whole words.

The quotas of all sources are then split among ``2 ** levels`` output shards by
a binary tree.  At each node half of the blocks go left, and how many of them
come from each source is drawn from the multivariate hypergeometric
distribution, source after source, exactly as if all blocks of the node had
been shuffled and cut in the middle.  A shard takes its number of blocks of a
source as the next stretch of that source's permuted blocks, so shards are
disjoint and together take the quota.  Inside a shard rows are shuffled by hash.

Only the table of sources and the tree are small data: sources times shards
rows, one task.  Word positions inside a source come from two levels of sums,
over hash buckets and inside them, so a source that holds most rows is spread
over many tasks.  All draws come from hashes of the seed: reruns agree.

* NULL texts have no words; documents without words are never taken.
* A NULL source is a source of its own, last in order.
* Rows equal in id, text and source are interchangeable and each counted.
* With no words at all every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm.common import KEYS, keyed, query, table, words
from flowloom.operators.lineage import cut

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK = 4096
LEVELS = 6
SEED = 17
# Documents of one bucket are put in order by one task.
BUCKET = 500


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document with its size in words and its place in the hash order."""
    return cut(
        keyed(docs).select(
            *KEYS,
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.size(words("text")).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), *KEYS, "source").alias("place"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def source_targets(
    rows: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """``s`` (number), ``source``, ``source_size``, ``n_docs`` and ``target``, one row per source.

    Sources take their weights in turn, by name in code point order.  Were a
    source above ``most`` times its size, it stays there and the others share
    the rest by weight.  In the order of size for weight the sources that stay
    come first, and the common rate of the others is the greatest of the rates
    that result from each number of sources staying.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("room") / F.col("weight"), "s")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    return (
        rows.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("s", F.row_number().over(every) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("s") % len(weights) + 1))
        .withColumn("room", most * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn(
            "rate",
            (F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0)))
            / F.sum("weight").over(after),
        )
        .withColumn("rate", F.max("rate").over(whole))
        .select(
            "s", "source", "source_size", "n_docs",
            F.least(F.col("room").cast("double"), F.col("weight") * F.col("rate")).alias("target"),
        )
    )


def quotas(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``targets`` with ``words`` to take, ``blocks`` of one pass and ``quota`` of blocks to draw."""
    size = F.greatest("source_size", F.lit(1).cast("long"))
    total = F.round("target").cast("long")
    return targets.withColumns(
        {
            "words": total,
            "blocks": F.ceil(F.col("source_size") / block).cast("long"),
            "quota": F.floor(total / size) * F.ceil(F.col("source_size") / block)
            + F.ceil((total % size) / block),
        }
    )


# Hypergeometric draw: of ``pop`` blocks, c are of this source, n are taken; how many
# of the c?  Weights relative to the most likely number m follow from the ratio of
# neighbours, outwards from m, up to eight standard deviations and some.  One walk
# adds them up, another stops where the share u of the sum is reached.
_UP = "(x.c - k + 1D) * (x.n - k + 1D) / (k * (x.pop - x.c - x.n + k))"
_DOWN = "(k + 1D) * (x.pop - x.c - x.n + k + 1D) / ((x.c - k) * (x.n - k))"


def _steps(first: str, last: str, step: int) -> str:
    there = f"{first} <= {last}" if step > 0 else f"{first} >= {last}"
    return f"CASE WHEN {there} THEN sequence({first}, {last}, {step}L) ELSE array() END"


def _walk(steps: str, ratio: str, start: str) -> str:
    return (
        f"aggregate({steps}, {start}, (a, k) -> struct(a.p * {ratio} AS p, a.sum + a.p * {ratio} AS sum,"
        f" CASE WHEN a.at IS NULL AND a.sum + a.p * {ratio} >= a.goal THEN k ELSE a.at END AS at,"
        f" a.goal AS goal))"
    )


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _draw(pop: str, c: str, n: str, u: str) -> str:
    none = "CAST(NULL AS BIGINT)"
    up = _steps("x.m + 1", "x.hi", 1)
    down = _steps("x.m - 1", "x.lo", -1)
    flat = f"struct(1D AS p, 0D AS sum, {none} AS at, CAST('Infinity' AS DOUBLE) AS goal)"
    both = f"1D + {_walk(up, _UP, flat)}.sum + {_walk(down, _DOWN, flat)}.sum"
    seek_up = _walk(up, _UP, f"struct(1D AS p, 1D AS sum, {none} AS at, g AS goal)")
    seek_down = _walk(down, _DOWN, f"struct(1D AS p, t.sum AS sum, {none} AS at, g AS goal)")
    found = _let(seek_up, "t", f"coalesce(t.at, {seek_down}.at, x.m)")
    pick = _let(f"x.u * ({both})", "g", f"CASE WHEN g <= 1D THEN x.m ELSE {found} END")
    given = f"struct({pop} AS pop, {c} AS c, {n} AS n, {u} AS u)"
    bounds = (
        "struct(y.pop AS pop, y.c AS c, y.n AS n, y.u AS u,"
        " CAST(8 * sqrt(y.n * (y.c / y.pop) * (1 - y.c / y.pop)) AS BIGINT) + 8 AS w,"
        " greatest(0L, y.n + y.c - y.pop) AS lo, least(y.n, y.c) AS hi,"
        " CAST(floor((y.n + 1D) * (y.c + 1D) / (y.pop + 2D)) AS BIGINT) AS m)"
    )
    around = (
        "struct(z.pop AS pop, z.c AS c, z.n AS n, z.u AS u,"
        " least(z.hi, greatest(z.lo, z.m)) AS m,"
        " greatest(z.lo, z.m - z.w) AS lo, least(z.hi, z.m + z.w) AS hi)"
    )
    drawn = _let(given, "y", _let(bounds, "z", _let(around, "x", pick)))
    return f"CASE WHEN {c} = 0 OR {n} = 0 THEN 0L WHEN {c} = {pop} THEN {n} ELSE {drawn} END"


def split_quotas(counts: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """``shard`` and ``counts`` for every leaf, from one row with the array ``counts`` of all quotas."""
    nodes = counts.select(F.lit(1).cast("long").alias("node"), "counts")
    u = f"(shiftrightunsigned(xxhash64({seed}, node, b.i), 11) + 0.5D) / 9007199254740992D"
    draw = _draw("b.rest", "c", "b.take", u)
    # One source after the other: b.rest blocks are left, b.take of them go left.
    left = (
        "aggregate(counts, struct(aggregate(counts, 0L, (a, c) -> a + c) AS rest,"
        " aggregate(counts, 0L, (a, c) -> a + c) div 2 AS take, 0 AS i,"
        " CAST(array() AS ARRAY<BIGINT>) AS out),"
        f" (b, c) -> {_let(draw, 'd', 'struct(b.rest - c AS rest, b.take - d AS take, b.i + 1 AS i, array_append(b.out, d) AS out)')},"
        " b -> b.out)"
    )
    for _ in range(levels):
        nodes = (
            nodes.withColumn("left", F.expr(left))
            .withColumn("right", F.expr("zip_with(counts, left, (c, d) -> c - d)"))
            .select(
                F.explode(
                    F.expr(
                        "array(struct(2 * node AS node, left AS counts),"
                        " struct(2 * node + 1 AS node, right AS counts))"
                    )
                ).alias("x")
            )
            .select("x.node", "x.counts")
        )
        nodes = cut(nodes)
    return nodes.select((F.col("node") - 2**levels).cast("int").alias("shard"), "counts")


def _allotted(plan: DataFrame, levels: int, seed: int) -> DataFrame:
    """Per source number the array ``starts``: at which of its drawn blocks each shard begins."""
    counts = plan.agg(
        F.expr("transform(sort_array(collect_list(struct(s, quota))), x -> x.quota)").alias("counts")
    ).filter("size(counts) > 0")
    by_source = Window.partitionBy("s").orderBy("shard")
    return (
        split_quotas(cut(counts), levels, seed)
        .select("shard", F.posexplode("counts").alias("s", "n"))
        .withColumn("start", F.sum("n").over(by_source) - F.col("n"))
        .groupBy("s")
        .agg(F.expr("transform(sort_array(collect_list(struct(shard, start))), x -> x.start)").alias("starts"))
    )


def _positions(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the source's plan and ``start``, the words before it in its source."""
    # Hashes are spread evenly, so a stretch of them holds about BUCKET documents.
    pieces = F.ceil(F.col("n_docs") / BUCKET)
    share = (F.col("place") / F.lit(2.0**64)) + 0.5
    placed = (
        rows.join(plan, rows["source"].eqNullSafe(plan["source"]))
        .drop(plan["source"])
        .withColumn("bucket", F.least(pieces - 1, F.floor(share * pieces)).cast("long"))
    )
    placed = cut(placed)
    upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("s", "bucket")
        .agg(F.sum("size").alias("in_bucket"))
        .select("s", "bucket", F.coalesce(F.sum("in_bucket").over(upto), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("s", "bucket").orderBy("place", "row")
    return placed.withColumn("inner", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(
        offsets, ["s", "bucket"]
    ).withColumn("start", F.col("offset") + F.col("inner") - F.col("size"))


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    most: int = MOST_COPIES,
    block: int = BLOCK,
    levels: int = LEVELS,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' ``sizes``, the plan per source, and the mixture.

    The mixture has a row for each stretch of a document that is taken: its
    ``row`` in the sizes, ``source``, ``doc_id``, ``shard``, ``position`` in the
    shard, the ``turn`` through the source, and the words ``begin`` to ``end``.
    """
    rows = sizes(docs, seed)
    plan = cut(quotas(source_targets(rows, weights, most), block))
    starts = _allotted(plan, levels, seed)
    full = cut(plan.join(starts, "s"))
    at = _positions(rows, full).filter("size > 0 AND words > 0")
    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.col("source_size")))
    # Of the turn that is not complete only the first words are taken.
    last = F.least("source_size", F.col("words") - F.col("turn") * F.col("source_size"))
    touched = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))
    draw = F.col("turn") * F.col("blocks") + F.col("b")
    pieces = (
        at.withColumn("turn", F.explode(turns))
        .withColumn("stop", F.least(F.col("start") + F.col("size"), last))
        .filter("start < stop")
        .withColumn("b", F.explode(touched))
        .withColumn("draw", draw)
        .select(
            "row", *KEYS, "doc_id", "source", "turn", "draw",
            F.expr("size(filter(starts, x -> x <= draw)) - 1").alias("shard"),
            (F.greatest("start", F.col("b") * block) - F.col("start")).alias("begin"),
            (F.least("stop", (F.col("b") + 1) * block) - F.col("start")).alias("end"),
        )
    )
    local = Window.partitionBy("shard").orderBy(
        F.xxhash64(F.lit(seed + 1), "source", "draw"), F.xxhash64(F.lit(seed + 2), *KEYS), "row"
    )
    return rows, plan, pieces.withColumn("position", F.row_number().over(local))


@query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plan, mixture = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = mixture.groupBy("row").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    known = plan.select(F.col("source").alias("__source"), "source_size", "target")
    return (
        rows.join(taken, "row", "left")
        .join(known, F.col("source").eqNullSafe(F.col("__source")), "left")
        .select(
            "doc_id", "size", "source_size", "target",
            F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        )
    )
