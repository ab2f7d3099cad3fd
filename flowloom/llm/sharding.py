"""Shards by a weighted hash tree: regions hold racks, racks hold shards.

A document descends from region to rack to shard.  At each level every child draws
a waiting time, ``-ln(u) / weight`` with ``u`` hashed from the child's path and the
document's key, and the child with the shortest one takes the document; so a child
takes as large a part as its weight, and a changed weight moves documents only
into or out of the subtrees that hold it.

What a region draws is the time of the first of its shards.  Below, a child
arrives at the time of its parent plus what it waits longer than the quickest
child.  As exponential waiting times have no memory, this gives every shard a
waiting time of its own, independent of all others; no draw is made for the
shards of a region that lost.  In the last region shards may still be missing:
only those that are there compete, full racks as a whole.  Hence a further
shard changes no other waiting time and takes documents only into itself,
however many there are already.

The key is ``doc_id``; a document without one is placed by its text.  Slots number
the documents of a shard from 0 without gaps, in the order of id, text hash and
size, then as they were read; a large shard is numbered in pieces along that order,
so no shard and no group of equal rows has to fit one task.

NULL texts have no bytes; repeated rows go to one shard and get a slot each; an
empty table gives no rows.  Columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import query, table
from flowloom.operators.lineage import cut
from flowloom.operators.spread import running
from flowloom.sources.sinks import write_partitioned

SHARDS = 24
RACKS, PER_RACK = 2, 4  # of a region, of a rack
OVERHEAD = 8
SEED = 42
DIGITS = 13  # 52 bits of a hash, which a double holds exactly


def _waiting(key: Column, path: Sequence[Column | str]) -> Column:
    """A waiting time of mean 1, drawn from the key and the path of a node."""
    name = F.concat_ws(".", F.lit(str(SEED)), *[p if isinstance(p, Column) else F.lit(p) for p in path])
    digits = F.substring(F.md5(F.concat(name, F.lit(":"), key)), 1, DIGITS)
    return -F.log((F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(16**DIGITS)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


class Tree:
    """The places for at least ``shards`` shards and what they weigh.

    ``weights`` are those of the first shards, in order; all others weigh 1.
    """

    def __init__(
        self, shards: int, racks: int = RACKS, per_rack: int = PER_RACK, weights: Sequence[float] = ()
    ) -> None:
        if shards < 1 or any(w <= 0 for w in weights):
            raise ValueError("there has to be a shard, and weights are above 0")
        self.shards, self.racks, self.per_rack = shards, racks, per_rack
        self.regions = -(-shards // (racks * per_rack))
        places = self.regions * racks * per_rack
        self.weights = [float(w) for w in [*weights, *[1.0] * places][:places]]
        self.even = len(set(self.weights)) == 1

    def _weight(self, first: Column, places: int) -> Column:
        """The weight of the ``places`` places from ``first`` on, which begin at a multiple of it."""
        if self.even:
            return F.lit(self.weights[0] * places)
        sums = [sum(self.weights[i : i + places]) for i in range(0, len(self.weights), places)]
        return F.element_at(F.array(*map(F.lit, sums)), (first / places).cast("int") + 1)

    def _children(self, key: Column, level: str, parent: Column, n: int, places: int) -> Column:
        """The children of a node as an array of (time, child).

        ``parent`` is the number of the node among all of its level.
        """

        def drawn(i: Column) -> Column:
            node = parent * n + i
            time = _waiting(key, [level, node.cast("string")]) / self._weight(node * places, places)
            return F.struct(time.alias("time"), i.alias("child"))

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), drawn)

    def place(self, key: Column, shards: int | None = None) -> Column:
        """The shard of a key when the first ``shards`` places are taken."""
        shards = self.shards if shards is None else shards
        size = self.racks * self.per_rack
        whole, rest = divmod(shards, size)
        racks, single = divmod(rest, self.per_rack)

        def found(time: Column, region: Column, rack: Column, shard: Column) -> Column:
            return F.struct(
                time.alias("time"), region.alias("region"), rack.alias("rack"), shard.alias("shard")
            )

        none = F.lit(-1)

        def whole_regions(regions: Column) -> Column:
            return F.transform(F.slice(regions, 1, whole), lambda r: found(r["time"], r["child"], none, none))

        # The last region: its racks, and the shards of its last rack, arrive one by one.
        last = F.lit(whole)

        def with_racks(regions: Column) -> Column:
            start = F.element_at(regions, -1)["time"]
            waits = _bound(
                F.struct(start.alias("start"), self._children(key, "rack", last, self.racks, self.per_rack).alias("racks")),
                lambda x: F.transform(
                    x["racks"],
                    lambda k: F.struct(
                        (x["start"] + k["time"] - F.array_min(x["racks"])["time"]).alias("time"), k["child"].alias("child")
                    ),
                ),
            )
            return _bound(waits, lambda w: F.concat(whole_regions(regions), in_racks(w)))

        def in_racks(waits: Column) -> Column:
            full = F.transform(F.slice(waits, 1, racks), lambda k: found(k["time"], last, k["child"], none))
            if not single:
                return full
            rack, begin = F.lit(racks), F.element_at(waits, racks + 1)["time"]
            shards_there = _bound(
                self._children(key, "shard", last * self.racks + rack, self.per_rack, 1),
                lambda below: F.transform(
                    F.slice(below, 1, single),
                    lambda s: found(begin + s["time"] - F.array_min(below)["time"], last, rack, s["child"]),
                ),
            )
            return F.concat(full, shards_there)

        regions = self._children(key, "region", F.lit(0), whole + (rest > 0), size)
        runners = _bound(regions, with_racks if rest else whole_regions)
        return self._descend(key, F.array_min(runners))

    def _descend(self, key: Column, best: Column) -> Column:
        """The shard below the node that won."""

        def rack_of(b: Column) -> Column:
            drawn = self._children(key, "rack", b["region"], self.racks, self.per_rack)
            rack = F.when(b["rack"] >= 0, b["rack"]).otherwise(F.array_min(drawn)["child"])
            return F.struct((b["region"] * self.racks + rack).alias("rack"), b["shard"].alias("shard"))

        def shard_of(b: Column) -> Column:
            drawn = self._children(key, "shard", b["rack"], self.per_rack, 1)
            shard = F.when(b["shard"] >= 0, b["shard"]).otherwise(F.array_min(drawn)["child"])
            return (b["rack"] * self.per_rack + shard).cast("int")

        return _bound(_bound(best, rack_of), shard_of)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size`` in bytes, overhead included, and ``text_crc32``."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumns(
        {
            "size": (F.octet_length(body) + OVERHEAD).cast("long"),
            "text_crc32": F.crc32(body).cast("long"),
        }
    )


def key_of(doc_id: Column, text_crc32: Column) -> Column:
    """What places a document: its id, or its text if it has none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), text_crc32.cast("string")))


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    weights: Sequence[float] = (),
    racks: int = RACKS,
    per_rack: int = PER_RACK,
    rows_per_task: int | None = None,
) -> DataFrame:
    """``docs``, which have ``doc_id``, ``size`` and ``text_crc32``, with ``shard``, ``slot`` and ``grown_shard``.

    ``grown_shard`` is the shard once there is one more.
    """
    tree = Tree(shards + 1, racks, per_rack, weights)
    names = ["shard", "slot", "grown_shard"]
    key = key_of(F.col("doc_id"), F.col("text_crc32"))
    # The row number is written with the rows and only read from then on.
    rows = cut(
        docs.drop(*names)
        .withColumn("shard", tree.place(key, shards))
        .withColumn("grown_shard", tree.place(key, shards + 1))
        .withColumn("__row", F.monotonically_increasing_id())
    )
    numbered = running(
        rows,
        ["shard"],
        ["doc_id", "text_crc32", "size", "__row"],
        sums={"slot": F.lit(1).cast("long")},
        rows_per_task=rows_per_task,
        total=rows.count(),
    )
    return numbered.withColumn("slot", F.col("slot") - 1).drop("__row")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **tree) -> None:
    """Write ``docs`` as one folder for each shard, with ``slot`` beside the columns of ``docs``."""
    done = assign(measured(docs), shards, **tree)
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    write_partitioned(done.select(*kept, "slot", "shard"), path, ["shard"])


# Fixed value: the polynomial of crc32, bits reversed.
_POLYNOMIAL = 0xEDB88320


def _crc_table() -> list[int]:
    rows = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (_POLYNOMIAL if value & 1 else 0)
        rows.append(value)
    return rows


def crc32_sql(blob: str) -> str:
    """crc32 of a BLOB expression, for DuckDB."""
    table = f"{_crc_table()}::UBIGINT[]"
    octets = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: ('0x' || h)::UBIGINT)"
    step = f"xor(a >> 8, ({table})[(xor(a, b) & 255)::BIGINT + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda a, b: {step}), 4294967295::UBIGINT)"


def _wait_sql(level: str, node: str) -> str:
    digits = f"substr(md5('{SEED}.{level}.' || {node} || ':' || key), 1, {DIGITS})"
    return f"-ln((('0x' || {digits})::UBIGINT::DOUBLE + 1) / {16**DIGITS}::DOUBLE)"


SQL = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + {OVERHEAD} AS size,
    {crc32_sql("encode(coalesce(text, ''))")}::BIGINT AS text_crc32, row_number() OVER () AS r FROM documents
), k AS (
  SELECT *, coalesce(doc_id::VARCHAR, 'text ' || text_crc32::VARCHAR) AS key FROM d
), leaf AS (
  SELECT r, key, leaf // {RACKS * PER_RACK} AS region, leaf // {PER_RACK} AS rack, leaf
  FROM k, (SELECT unnest(range({-(-(SHARDS + 1) // (RACKS * PER_RACK)) * RACKS * PER_RACK})) AS leaf)
), w AS (
  SELECT r, region, rack, leaf,
    {_wait_sql("region", "region")} / {RACKS * PER_RACK} AS first, {_wait_sql("rack", "rack")} / {PER_RACK} AS second,
    {_wait_sql("shard", "leaf")} AS third
  FROM leaf
), t AS (
  SELECT r, leaf, first + second - min(second) OVER (PARTITION BY r, region)
    + third - min(third) OVER (PARTITION BY r, rack) AS time FROM w
), p AS (
  SELECT r, arg_min(leaf, time) FILTER (leaf < {SHARDS}) AS shard,
    arg_min(leaf, time) FILTER (leaf <= {SHARDS}) AS grown FROM t GROUP BY r
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  grown::INTEGER AS grown_shard
FROM d JOIN p USING (r)
"""


@query("op13_sharding", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = measured(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
