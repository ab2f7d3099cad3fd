"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A document's set holds a 64-bit hash of each distinct run of ``shingle`` words.
Its signature has ``SYMBOLS`` minima of ``BITS`` bits each.  Two documents of
similarity s differ in about a share ``1 - s`` of the symbols, so pairs of 0.8
and more differ in 12.8 of 64 on average; ``DISTANCE`` is 4.4 deviations above.

Signatures within ``DISTANCE`` are found without comparing all of them.  The
symbols are split into ``CHUNKS`` chunks.  If two signatures differ in at most
``DISTANCE`` symbols, then by the pigeonhole principle at least

    CHUNKS - DISTANCE // 2  =  3

chunks differ in at most one symbol.  A chunk with one symbol left out is a key;
two chunks differ in at most one symbol exactly if they share such a key.  So
all pairs within the distance share keys, of three different chunks at least.

Equal sets are one class from the start.  A class that shares no more than it
would need goes at once: shingles that none of the classes it shares a key with
has are in no intersection, so a class with more than a fifth of them has no
link, and a pair can only link if what both have alone leaves room for it.  This
is exact, and it takes out the heavily edited copies that would otherwise meet
all others of their group.  Then, class by class:

1. Each key that several classes have gets a leader, and only (member, leader)
   pairs are compared: linear in the members, however many share the key.  A
   second round takes other leaders, for members not yet joined to theirs.
2. What is left are pairs in one key but in different components.  They are
   compared exactly, in blocks of ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles,
   so that no key has to fit one task, each pair in one key.
   Such a pair is also held against ``MORE`` symbols: over all 256 a similarity
   of 0.8 differs in 51.2 on average, ``WIDE_DISTANCE`` is 4.3 deviations above.
   Members that are in such a pair meet once more with their full sets, and only
   links that join two components leave the task.
3. Pairs with leaders are confirmed on the full sets too, and components of
   the confirmed links are formed in rounds.

Links inside one component need no test, as classes and components are the
result.  No bucket, partner or candidate is capped.

* NULL and empty texts, and texts without words, have no set and no link; a
  text with fewer words than a shingle is one shingle.
* ``component_id`` is the least non-NULL ``doc_id`` reachable, NULL if none is.
* Repeated rows are linked with each other, as equal sets are.
* Columns of the same names in the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import KEYS, keyed, query, table
from flowloom.llm.wordhash import chunks, word_hashes
from flowloom.operators.iterate import connected_components
from flowloom.operators.lineage import cut

SYMBOLS = 64
BITS = 16
CHUNK = 4
CHUNKS = SYMBOLS // CHUNK
DISTANCE = 27
# Further symbols that only candidates are held against, and the distance over all.
MORE = 192
WIDE_DISTANCE = 79
BLOCK = 1000
PERCENT = 80
# Members of a key that are held against each other at once: so many, or of so many
# shingles together.
BLOCK_SHINGLES = 2_000_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, ASCII letters in lower case."""
    words, counts = word_hashes([t.lower() for t in texts])
    begins = np.cumsum(counts) - counts
    runs = np.full(max(0, len(words) - shingle + 1), shingle, np.uint64)
    for k in range(shingle):
        runs = _mix(runs + words[k : len(runs) + k] * _M3)
    found = []
    for begin, n in zip(begins.tolist(), counts.tolist()):
        if n >= shingle:
            found.append(np.unique(runs[begin : begin + n - shingle + 1]))
            continue
        # Fewer words than a shingle: all of them are one.
        short = np.full(min(n, 1), n, np.uint64)
        for k in range(n):
            short = _mix(short + words[begin + k] * _M3)
        found.append(short)
    return found


def _seeds(first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = _mix(np.arange(first, first + 2 * n, dtype=np.uint64) * _M3)
    return drawn[:n, None] | np.uint64(1), drawn[n:, None]


_MAIN = _seeds(1, SYMBOLS)
_FURTHER = _seeds(1 + 2 * SYMBOLS, MORE)


def signature(hashes: np.ndarray, seeds: tuple = _MAIN) -> bytes:
    """The low bits of the least value of each of the permutations, ``SYMBOLS`` as a rule."""
    least = np.full(len(seeds[0]), ~np.uint64(0))
    for k in range(0, len(hashes), 2048):
        x = hashes[None, k : k + 2048] * seeds[0]
        x += seeds[1]
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(axis=1), out=least)
    return _mix(least).astype(np.uint16).tobytes()


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of each row of symbols: every chunk with each of its symbols left out in turn."""
    parts = signatures.reshape(len(signatures), CHUNKS, CHUNK).astype(np.uint64)
    keys = []
    for skip in range(CHUNK):
        left = [parts[:, :, k] for k in range(CHUNK) if k != skip]
        value = np.full(left[0].shape, skip, np.uint64)
        for symbol in left:
            value = (value << np.uint64(BITS)) | symbol
        keys.append(value + np.arange(CHUNKS, dtype=np.uint64) * _M3)
    return _mix(np.stack(keys, axis=2).reshape(len(signatures), CHUNKS * CHUNK))


def _symbols(column: pa.Array, n: int = SYMBOLS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, n)


def _further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The further symbols of each set."""
    for batch in batches:
        sets = (np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("data"))
        more = [signature(x, _FURTHER) for x in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("cid"), pa.array(more, pa.binary())], ["cid", "more"]
        )


def _sets(shingle: int, full: bool):
    """Per text the size and digest of its set, and the set or the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, data = [], [], []
            for found in chain.from_iterable(
                shingle_sets(texts, shingle) for _, texts in chunks(batch.column("text"))
            ):
                sizes.append(len(found))
                raw = found.tobytes()
                digests.append(xxhash.xxh3_128_digest(raw) if len(found) else None)
                data.append(raw if full else signature(found) if len(found) else None)
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in rest],
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(data, pa.binary()),
                ],
                [*rest, "size", "digest", "data"],
            )

    return run


def _spread_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = chunk_keys(_symbols(batch.column("data")))
        for k in range(0, len(keys), 1000):
            some = keys[k : k + 1000]
            ids = np.repeat(batch.column("cid").to_numpy()[k : k + 1000], some.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "cid"]
            )


def _meet(a: dict, b: dict, same: bool, key: np.uint64, percent: int) -> Iterator[tuple]:
    """Places of near pairs in two blocks of one key, each pair at the least key that it shares."""
    for k in range(0, len(a["cid"]), 256):
        x = {c: v[k : k + 256] for c, v in a.items()}
        shared = np.minimum((x["size"] - x["alone"])[:, None], (b["size"] - b["alone"])[None])
        union = np.maximum(x["size"][:, None] + b["alone"][None], b["size"][None] + x["alone"][:, None])
        may = (x["part"][:, None] != b["part"][None]) & (100 * shared >= percent * union)
        if same:  # each pair once
            may &= x["cid"][:, None] < b["cid"][None]
        left, right = np.nonzero(may)
        for m in range(0, len(left), 50_000):
            i, j = left[m : m + 50_000], right[m : m + 50_000]
            apart = (x["data"][i] != b["data"][j]).sum(axis=1)
            near = apart <= DISTANCE
            i, j, apart = i[near], j[near], apart[near]
            wide = apart + (x["more"][i] != b["more"][j]).sum(axis=1) <= WIDE_DISTANCE
            i, j = i[wide], j[wide]
            if len(i):
                mine, theirs = chunk_keys(x["data"][i]), chunk_keys(b["data"][j])
                first = np.where(mine == theirs, mine, ~np.uint64(0)).min(axis=1) == key
                yield i[first] + k, j[first]


def _blocks(rows: pa.Table) -> tuple[dict, dict, bool, np.uint64, np.ndarray, np.ndarray]:
    """The two blocks of a group, whether they are one, its key, and the rows of either."""
    cols = {c: rows[c].to_numpy() for c in ("cid", "part", "size", "alone")}
    cols["data"], cols["more"] = _symbols(rows["data"]), _symbols(rows["more"], MORE)
    own, one, two = (rows[c].to_numpy() for c in ("own", "one", "two"))
    left, right = np.flatnonzero(own == one[0]), np.flatnonzero(own == two[0])
    a, b = ({c: v[m] for c, v in cols.items()} for m in (left, right))
    return a, b, one[0] == two[0], rows["key"].to_numpy()[:1].view(np.uint64)[0], left, right


def _in_pairs(percent: int):
    """The members of a group that are in a near pair."""

    def members(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b, same, key, left, right = _blocks(rows)
        found = np.zeros(rows.num_rows, bool)
        for i, j in _meet(a, b, same, key, percent):
            found[left[i]] = found[right[j]] = True
        kept = rows.select(["key", "one", "two", "own", "cid"]).filter(pa.array(found))
        yield from kept.combine_chunks().to_batches()

    return _by_group(members)


def _links(percent: int):
    """The links of a group that join components: near pairs whose full sets reach the similarity.

    A pair that earlier links of the group have brought together already needs no test.
    """

    def joins(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b, same, key, left, right = _blocks(rows)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["set"]]
        leads: dict[int, int] = {}

        def lead(part: int) -> int:
            while part in leads:
                part = leads[part]
            return part

        ends: tuple[list[int], list[int]] = ([], [])
        for first, second in _meet(a, b, same, key, percent):
            for i, j in zip(first.tolist(), second.tolist()):
                p, q = lead(int(a["part"][i])), lead(int(b["part"][j]))
                if p != q and _reach(sets[left[i]], sets[right[j]], percent):
                    leads[max(p, q)] = min(p, q)
                    ends[0].append(int(a["cid"][i]))
                    ends[1].append(int(b["cid"][j]))
        if ends[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["a", "b"])

    return _by_group(joins)


def _by_group(use):
    """``use`` of the rows of each key and pair of blocks (``one``, ``two``).

    Rows come sorted by these, of at most some ``BLOCK`` members each; only one such
    group is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy() for c in ("key", "one", "two")], axis=1)
            edges = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            starts = [0, *edges.tolist()]
            for at, end in zip(starts, [*starts[1:], batch.num_rows]):
                here = tuple(place[at])
                if held and here != last:
                    yield from use(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(at, end - at))
                last = here
        if held:
            yield from use(pa.Table.from_batches(held))

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures are within the distance."""
    for batch in batches:
        if not batch.num_rows:
            continue
        differ = (_symbols(batch.column("data_a")) != _symbols(batch.column("data_b"))).sum(axis=1)
        yield batch.select(["a", "b"]).filter(pa.array(differ <= DISTANCE))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set."""
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            raw = part.column("data").to_pylist()
            hashes = np.frombuffer(b"".join(raw), np.int64)
            ids = np.repeat(part.column("cid").to_numpy(), [len(x) // 8 for x in raw])
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids)], ["hash", "cid"])


def _reach(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two full sets reach the similarity."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return bool(100 * both >= percent * (len(x) + len(y) - both))


def _confirm(percent: int):
    """Pairs whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                good.append(_reach(x, y, percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


class _Linker:
    """Confirms candidate pairs of classes and keeps the links and components so far."""

    def __init__(self, facts: DataFrame, sets: DataFrame, percent: int) -> None:
        self.facts, self.sets, self.percent = facts, sets, percent
        self.links: list[DataFrame] = []
        self.parts: DataFrame | None = None

    def component(self, df: DataFrame, cid: str, name: str) -> DataFrame:
        """``df`` with the component of ``cid``; a class without links is its own."""
        if self.parts is None:
            return df.withColumn(name, F.col(cid))
        parts = self.parts.select(F.col("node").alias(cid), F.col("component").alias("__part"))
        return (
            df.join(parts, cid, "left")
            .withColumn(name, F.coalesce("__part", cid))
            .drop("__part")
        )

    def _side(self, end: str) -> DataFrame:
        names = {"cid": end, "size": f"size_{end}", "alone": f"alone_{end}", "data": f"data_{end}"}
        return self.facts.select(*[F.col(c).alias(n) for c, n in names.items()])

    def test(self, pairs: DataFrame) -> None:
        """Add the links among ``pairs`` (a, b), which are distinct and in different components."""
        sized = (
            pairs.join(self._side("a"), "a")
            .join(self._side("b"), "b")
            .filter(_may_link(self.percent))
            .select("a", "b", "data_a", "data_b")
        )
        self.confirm(cut(sized.mapInArrow(_near, "a long, b long")))

    def confirm(self, near: DataFrame) -> None:
        """Add the links among pairs within the distance."""
        if near.isEmpty():
            return
        links = cut(
            near.join(self.sets.select(F.col("cid").alias("a"), F.col("data").alias("set_a")), "a")
            .join(self.sets.select(F.col("cid").alias("b"), F.col("data").alias("set_b")), "b")
            .mapInArrow(_confirm(self.percent), "a long, b long")
        )
        self.add(links)

    def add(self, links: DataFrame) -> None:
        """Add written links and find the components anew."""
        if links.isEmpty():
            return
        self.links.append(links)
        every = self.links[0]
        for more in self.links[1:]:
            every = every.unionByName(more)
        self.parts = cut(
            connected_components(every.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        )


def _may_link(percent: int) -> Column:
    """Whether two classes can reach the similarity, by their sizes and what each has alone.

    What only one of them has is in the union and not in what they share.
    """
    shared = F.least(F.col("size_a") - F.col("alone_a"), F.col("size_b") - F.col("alone_b"))
    union = F.greatest(F.col("size_a") + F.col("alone_b"), F.col("size_b") + F.col("alone_a"))
    return 100 * shared >= percent * union


def _full_sets(docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """``cid`` and ``data``, the whole set of each class, cut anew from one of its texts."""
    found = (
        keyed(docs)
        .select(*KEYS, F.col("text").cast("binary").alias("text"))
        .join(classes.select("cid", *KEYS).hint("merge"), KEYS)
        .select("cid", "text")
        .mapInArrow(_sets(shingle, True), "cid long, size long, digest binary, data binary")
        .select("cid", "data")
    )
    # Rows of equal id and text give a set twice; a pair then only comes twice.
    return cut(found)


def _alone(sets: DataFrame) -> DataFrame:
    """``cid`` and ``alone``, how many of its shingles no other of the ``sets`` has."""
    return (
        sets.mapInArrow(_shingles, "hash long, cid long")
        .groupBy("hash")
        .agg(F.min("cid").alias("cid"), F.max("cid").alias("other"))
        .filter("cid = other")
        .groupBy("cid")
        .agg(F.count(F.lit(1)).alias("alone"))
    )


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` per row, with the row keys."""
    return _grouped(docs, shingle, percent).drop("part")


def _grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``near_duplicates`` with ``part``, a number for each group, whether it has ids or not."""
    rows = cut(
        keyed(docs)
        .select(*KEYS, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        .mapInArrow(
            _sets(shingle, False),
            "__k1 long, __k2 long, doc_id long, size long, digest binary, data binary",
        )
    )
    one = F.struct("doc_id", *KEYS)
    classes = cut(
        rows.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.min(one).alias("one"),
            F.first("size").alias("size"),
            F.first("data").alias("data"),
        )
        .select("digest", "least_id", "one.__k1", "one.__k2", "size", "data")
        # Numbers are given once, in a table that is only read from here on.
        .withColumn("cid", F.monotonically_increasing_id())
    )
    spread = classes.select("cid", "data").mapInArrow(_spread_keys, "key long, cid long")
    shared = cut(
        spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    )
    met = cut(spread.join(shared, "key"))
    # Partners share a key, so all that can be shared is in the classes that do.
    sets = _full_sets(docs, classes.join(met.select("cid").distinct(), "cid", "left_semi"), shingle)
    facts = cut(
        classes.select("cid", "size", "data")
        .join(_alone(sets), "cid", "left")
        .withColumn("alone", F.coalesce("alone", F.lit(0)))
        .filter(100 * (F.col("size") - F.col("alone")) >= percent * F.col("size"))
    )
    lists = met.groupBy("cid").agg(F.collect_list("key").alias("keys"))
    met = cut(lists.join(facts.select("cid"), "cid").select(F.explode("keys").alias("key"), "cid"))
    shared = cut(
        met.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("leader"))
        .filter("n > 1")
    )
    members = cut(met.join(shared, "key"))
    linker = _Linker(facts, sets, percent)
    linker.test(
        members.filter("cid <> leader")
        .select(F.col("leader").alias("a"), F.col("cid").alias("b"))
        .distinct()
    )
    # Other leaders for what is not in the component of its leader by now.
    split = cut(
        linker.component(linker.component(members, "leader", "lead_part"), "cid", "part").select(
            "key", "cid", "part", "n"
        )
    )
    order = F.xxhash64("key", "cid")
    several = cut(
        split.groupBy("key")
        .agg(
            F.min("part").alias("low"),
            F.max("part").alias("high"),
            F.min_by(F.struct("cid", "part"), order).alias("lead"),
        )
        .filter("low < high")
        .select("key", F.col("lead.cid").alias("a"), F.col("lead.part").alias("lead_part"))
    )
    left = cut(split.join(several, "key"))
    before = len(linker.links)
    linker.test(
        left.filter("part <> lead_part")
        .select(F.least("a", "cid").alias("a"), F.greatest("a", "cid").alias("b"))
        .distinct()
    )
    # Everything that shares a key and is still apart.
    if len(linker.links) > before:
        left = cut(linker.component(left.drop("part"), "cid", "part").select("key", "cid", "part", "n"))
        apart = (
            left.groupBy("key")
            .agg(F.min("part").alias("low"), F.max("part").alias("high"))
            .filter("low < high")
            .select("key")
        )
        left = cut(left.join(cut(apart), "key"))
    # Blocks follow the members that are still apart, not all that have the key.
    # What a class brings along is joined once for the class, which has a list of at most
    # CHUNKS * CHUNK keys, and goes to its keys from there.
    lists = cut(
        left.groupBy("cid", "part")
        .agg(F.collect_list("key").alias("keys"))
        .join(facts.select("cid", "size", "alone", "data"), "cid")
    )
    further = (
        sets.join(lists.select("cid"), "cid", "left_semi")
        .mapInArrow(_further, "cid long, more binary")
        .dropDuplicates(["cid"])
    )
    left = cut(
        lists.join(further, "cid").select(
            F.explode("keys").alias("key"), "cid", "part", "size", "alone", "data", "more"
        )
    )
    blocks = cut(
        left.groupBy("key").agg(
            F.greatest(
                F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)
            ).cast("int").alias("blocks")
        )
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    group = ["key", "one", "two"]
    grouped = (
        left.join(blocks, "key")
        .withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        .withColumn("other", other)
        .withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
        .select(*group, "own", "cid", "part", "size", "alone", "data", "more")
        .repartition(*group)
        .sortWithinPartitions(*group)
    )
    # Members in near pairs meet again with their full sets; no pair leaves a task before it is a link.
    near = cut(grouped.mapInArrow(_in_pairs(percent), "key long, one int, two int, own int, cid long"))
    if not near.isEmpty():
        of = left.select("key", "cid", "part", "size", "alone", "data", "more")
        full = sets.dropDuplicates(["cid"]).select("cid", F.col("data").alias("set"))
        linker.add(
            cut(
                near.join(of, ["key", "cid"])
                .join(full, "cid")
                .repartition(*group)
                .sortWithinPartitions(*group)
                .mapInArrow(_links(percent), "a long, b long")
            )
        )
    whole = cut(linker.component(classes.select("digest", "cid", "least_id"), "cid", "part"))
    reach = cut(whole.groupBy("part").agg(F.min("least_id").alias("component_id")))
    by_digest = cut(whole.join(reach, "part").select("digest", "part", "component_id"))
    # Documents without a set are their own component.
    linked = rows.filter("digest IS NOT NULL").join(by_digest, "digest")
    alone = rows.filter("digest IS NULL").withColumns(
        {"component_id": F.col("doc_id"), "part": F.lit(None).cast("long")}
    )
    names = [*KEYS, "doc_id", F.col("size").alias("n_shingles"), "component_id", "part"]
    return (
        linked.select(*names)
        .unionByName(alone.select(*names))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with its own columns: the one of least ``doc_id``, NULL last.

    Of different texts that share that id, or have none, the one of least key stays.
    Of rows equal in id and text one stays.  Documents without words all stay.
    """
    found = _grouped(docs, shingle, percent)
    left = cut(found.filter("NOT kept OR part IS NOT NULL").select(*KEYS, "part", "kept", "doc_id"))
    gone = left.filter("NOT kept").select(*KEYS)
    # Several texts of a group are left where ids are missing or shared.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEYS)
    tied = cut(
        left.filter("kept")
        .groupBy("part")
        .agg(F.min(order).alias("one"), F.max(order).alias("end"))
        .filter("one < end")
        .select("part", "one")
    )
    if not tied.isEmpty():
        more = left.filter("kept").join(tied, "part").filter(order > F.col("one"))
        gone = gone.unionByName(more.select(*KEYS))
    gone = cut(gone.distinct())
    # The list grows with the documents, so it is shuffled at every size.
    stay = keyed(docs).join(gone.hint("merge"), KEYS, "left_anti")
    twice = cut(
        found.filter("kept AND n_shingles > 0").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    if not twice.isEmpty():
        double = stay.join(twice.drop("n"), KEYS, "left_semi").dropDuplicates(KEYS)
        stay = stay.join(twice, KEYS, "left_anti").unionByName(double)
    return stay.select(*docs.columns)


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_W} AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4
    THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 3),
      lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m
                    FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 80 * (p.n + q.n - m)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


@query("op2_near_duplicates", SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).drop(*KEYS)
