"""Repeated passages across and within documents, by winnowing over line hashes.

Where a line of the text ends says nothing about where a passage ends, so the lines
that are hashed are not those of the text: a *line* here is ``LINE`` words in a row,
beginning at any word, whatever white space stands between them.  Of the lines inside
a *window* of ``RUN`` words the one with the least hash is its fingerprint, so equal
windows have equal fingerprints.  Windows that follow each other and have the same
fingerprint are a *stretch*: most texts have one for every fifteen words or so.

1. Fingerprints are counted, once for each place in a document; only those that
   occur twice go on.
2. The stretches of a repeated fingerprint are joined, in document order, then by
   position.  Each is laid on the first one at the place of the fingerprint, and the
   match is extended word by word both ways.  A match of ``RUN`` words or more is a
   later repeated run and goes.
3. Where the first place does not account for all of a stretch, its windows are held
   against those of all earlier stretches, each window against the first place that
   has it.  This is linear in the words, and nothing is lost: equal windows always
   meet in their fingerprint.

So a word goes exactly if it is in a window that occurs earlier; within a document
the earlier one must not overlap.  A line of the text that loses all its words
goes; one that loses some keeps the others.  The first occurrence of a window is not
removed for its sake, so every run removed has an equal one earlier.

Documents are ordered by ``doc_id`` (NULL last), then by a hash of the text.
Rows equal in both count as one document and lose the same words.  NULL and
empty texts stay as they are.  Columns of the same names are replaced.  Words are
told apart by 64 bits of hash in fingerprints and by 32 where matches are extended.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import KEYS, keyed, query, table
from flowloom.llm.wordhash import chunks, mixed, word_hashes
from flowloom.operators.lineage import cut

RUN = 50
LINE = 20
# Documents with one fingerprint that a task compares at once.
GROUP = 1000

# The odd multiplier of the rolling hashes, with its inverse.
_BASE = 0x9E3779B97F4A7C13
_BACK = pow(_BASE, -1, 1 << 64)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class _Powers:
    """Powers of the multiplier and of its inverse, as many as the longest text so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 4096)
            steps = [np.full(size, base, np.uint64) for base in (_BASE, _BACK)]
            for x in steps:
                x[0] = 1
            self.up, self.down = (np.multiply.accumulate(x) for x in steps)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all runs of ``size`` words."""
    n = len(words)
    up, down = _POWERS.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mixed((sums[size:] - sums[: n + 1 - size]) * down[: n + 1 - size], size)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, from running minima of blocks both ways."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


class Words:
    """The word hashes of several texts in a row, and their windows by fingerprint."""

    def __init__(self, texts: list[bytes], run: int, line: int) -> None:
        hashes, sizes = word_hashes(texts)
        long = sizes >= run
        self.hashes = hashes if long.all() else hashes[np.repeat(long, sizes)]
        self.sizes = np.where(long, sizes, 0)
        self.begins = np.cumsum(self.sizes) - self.sizes
        n = len(self.hashes)
        self._width = run - line + 1
        if not n:
            self.lines = self.prints = np.empty(0, np.uint64)
            self.text = self.start = self.count = np.empty(0, np.int64)
            return
        self.lines = _rolled(self.hashes, line)
        owner = np.repeat(np.arange(len(texts)), self.sizes)
        windows = np.flatnonzero(owner[: n - run + 1] == owner[run - 1 :])
        least, of = _least(self.lines, self._width)[windows], owner[windows]
        new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (of[1:] != of[:-1])])
        # A stretch: its fingerprint, its text, its first word and its number of windows.
        self.prints, self.text = least[new], of[new]
        self.start, self.count = windows[new], np.diff(np.r_[new, len(windows)])

    def again(self) -> np.ndarray:
        """Whether a stretch has its fingerprint in several places: no place is in more windows."""
        return self.count > self._width

    def anchors(self, which: np.ndarray) -> np.ndarray:
        """Where in a stretch its fingerprint is found first."""
        near = self.lines[self.start[which][:, None] + np.arange(self._width)]
        return (near == self.prints[which][:, None]).argmax(axis=1)


def _long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _lists(parts: list[np.ndarray], sizes: list[np.ndarray], kind: type) -> pa.Array:
    """One list for each of the sizes, from the values of all in a row."""
    ends = np.cumsum(np.concatenate([[0], *sizes]))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.empty(0, kind), *parts])))


def _prints(run: int, line: int):
    """Fingerprints of documents, twice where a document has one in several places."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for _, texts in chunks(batch.column("text")):
                w = Words(texts, run, line)
                order = np.lexsort((w.prints, w.text))
                text, prints, again = w.text[order], w.prints[order], w.again()[order]
                first = np.r_[True, (prints[1:] != prints[:-1]) | (text[1:] != text[:-1])][: len(prints)]
                places = np.add.reduceat(1 + again.astype(np.int64), np.flatnonzero(first)) if len(prints) else first
                text, prints = text[first], _long(prints[first])
                twice = np.minimum(places, 2)
                out.append(np.repeat(prints, twice))
                sizes.append(np.bincount(text, weights=twice, minlength=len(texts)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in KEYS], _lists(out, sizes, np.int64)], [*KEYS, "prints"]
            )

    return scan


def _stretches(run: int, line: int):
    """A row for each stretch with a repeated fingerprint: its words, or its windows if ``wide``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            again, many = (
                np.unique(batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                for c in ("again", "many")
            )
            for at, texts in chunks(batch.column("text")):
                w = Words(texts, run, line)
                which = np.flatnonzero(np.isin(w.prints, again))
                if not len(which):
                    continue
                start, count = w.start[which], w.count[which]
                wide = np.isin(w.prints[which], many)
                short = (w.hashes >> np.uint64(32)).astype(np.uint32)
                whole = _long(_rolled(w.hashes, run)) if wide.any() else None
                words, windows = [], []
                for i, n, v in zip(start.tolist(), count.tolist(), wide.tolist()):
                    words.append(None if v else short[i : i + n + run - 1].tobytes())
                    windows.append(whole[i : i + n] if v else np.empty(0, np.int64))
                take = pa.array(at + w.text[which])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).take(take) for c in (*KEYS, "none")],
                        pa.array(_long(w.prints[which])),
                        pa.array(wide),
                        pa.array((start - w.begins[w.text[which]]).astype(np.int32)),
                        pa.array(w.anchors(which).astype(np.int32)),
                        pa.array(words, pa.binary()),
                        _lists(windows, [np.array([len(x) for x in windows], np.int64)], np.int64),
                    ],
                    [*KEYS, "none", "print", "wide", "first", "anchor", "words", "windows"],
                )

    return scan


def extended(own: np.ndarray, anchor: int, home: np.ndarray, place: int) -> tuple[int, int]:
    """From where to where ``own`` matches ``home`` when ``anchor`` lies on ``place``."""
    left, right = min(anchor, place), min(len(own) - anchor, len(home) - place)
    front = own[anchor - left : anchor][::-1] != home[place - left : place][::-1]
    back = own[anchor : anchor + right] != home[place : place + right]
    before = int(front.argmax()) if front.any() else left
    after = int(back.argmax()) if back.any() else right
    return anchor - before, anchor + after


class _Group:
    """The stretches of one fingerprint so far."""

    def __init__(self, run: int, line: int) -> None:
        self.run, self.width = run, run - line + 1
        self.home: tuple | None = None
        self.windows: dict | None = None

    def _against_all(self, own: tuple, first: int, words: bytes) -> list[int]:
        """First words of the windows that an earlier stretch has."""
        lost = []
        hashes = np.frombuffer(words, np.uint32).astype(np.uint64)
        for i, window in enumerate(_rolled(hashes, self.run).tolist(), first):
            doc, j = self.windows.setdefault(window, (own, i))
            if doc != own or i >= j + self.run:
                lost.append(i)
        return lost

    def add(self, own: tuple, first: int, anchor: int, words: bytes) -> list[tuple[int, int]]:
        """What of the next stretch is a later run, as first word and end."""
        size = len(words) // 4
        loop = size - self.run + 1 > self.width
        if self.home is None:
            self.home = own, first, anchor, words
            if not loop:
                return []
        doc, start, place, text = self.home
        spans = []
        if doc != own or first + anchor - start - place >= self.run:
            if words == text and anchor == place:
                return [(first, first + size)]
            begin, end = extended(np.frombuffer(words, np.uint32), anchor, np.frombuffer(text, np.uint32), place)
            if end - begin >= self.run:
                spans.append((first + begin, first + end))
                if end - begin == size:
                    return spans
        if self.windows is None:
            self.windows = {}
            if self.home[:2] != (own, first):
                self._against_all(doc, start, text)
        for i in self._against_all(own, first, words):
            if spans and spans[-1][0] <= i <= spans[-1][1]:
                spans[-1] = spans[-1][0], max(spans[-1][1], i + self.run)
            else:
                spans.append((i, i + self.run))
        return spans


def _later(run: int, line: int):
    """Runs that occur earlier; rows come by fingerprint, document order and position."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, None
        for batch in batches:
            names = ("print", "none", *KEYS, "first", "anchor", "words")
            rows, begins, ends = [], [], []
            for k, (name, *own, first, anchor, words) in enumerate(
                zip(*[batch.column(c).to_pylist() for c in names])
            ):
                if name != now:
                    now, group = name, _Group(run, line)
                for begin, end in group.add(tuple(own), first, anchor, words):
                    rows.append(k)
                    begins.append(begin)
                    ends.append(end)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(take) for c in KEYS], pa.array(begins, pa.int32()), pa.array(ends, pa.int32())],
                [*KEYS, "begin", "end"],
            )

    return scan


def without(text: str, begins: list[int], ends: list[int]) -> tuple[str, int]:
    """``text`` without the words of these runs, given in order, and how many lines lost words."""
    at = 0
    end = word = lost = 0
    left = []
    for line in text.split("\n"):
        keep, hurt, any_word = [], False, False
        # Where the part of the line begins that is kept, or None inside removed words.
        begin, last = 0, 0
        for m in _WORD.finditer(line):
            any_word = True
            while at < len(begins) and begins[at] <= word:
                end = max(end, ends[at])
                at += 1
            if word < end:
                if begin is not None:
                    # White space before a removed passage stays, that behind it goes.
                    keep.append(line[begin : m.start()])
                    begin = None
                hurt = True
            else:
                if begin is None:
                    begin = m.start()
                last = m.end()
            word += 1
        if not hurt:
            left.append(line)
            continue
        lost += 1
        if last:
            keep.append(line[begin:] if begin is not None else "")
            left.append("".join(keep) if begin is not None else "".join(keep).rstrip(" \t\x0b\x0c\r"))
    return "\n".join(left), lost


def repeated_runs(docs: DataFrame, run: int = RUN, line: int = LINE) -> DataFrame:
    """``__k1``, ``__k2`` and ``gone``, the runs of words to remove as structs of ``begin`` and
    ``end`` (from 0, end excluded) in order; only documents with some."""
    texts = keyed(docs).select(
        *KEYS, F.col("doc_id").isNull().alias("none"), F.col("text").cast("binary").alias("text")
    )
    prints = cut(
        texts.select(*KEYS, "text")
        .mapInArrow(_prints(run, line), "__k1 long, __k2 long, prints array<long>")
        .filter("size(prints) > 0")
    ).select(*KEYS, F.explode("prints").alias("print"))
    again = cut(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # All of these lists grow with the documents, so they are shuffled at every size.
    hit = cut(
        prints.join(again.hint("merge"), "print")
        .groupBy(*KEYS)
        .agg(
            F.collect_set("print").alias("again"),
            F.collect_set(F.when(F.col("n") > GROUP, F.col("print"))).alias("many"),
        )
    )
    stretches = cut(
        texts.join(hit.hint("merge"), KEYS)
        .select(*KEYS, "none", "text", "again", "many")
        .mapInArrow(
            _stretches(run, line),
            "__k1 long, __k2 long, none boolean, print long, wide boolean, first int, anchor int,"
            " words binary, windows array<long>",
        )
    )
    # Up to GROUP documents with a fingerprint are held against each other in one task.
    few = (
        stretches.filter("NOT wide")
        .select("print", "none", *KEYS, "first", "anchor", "words")
        .repartition("print")
        .sortWithinPartitions("print", "none", *KEYS, "first")
        .mapInArrow(_later(run, line), "__k1 long, __k2 long, begin int, end int")
    )
    # Windows of more go by themselves: their first places are combined before the shuffle.
    each = stretches.filter("wide").select(*KEYS, "none", "first", F.posexplode("windows").alias("i", "window")).select(
        *KEYS, "none", "window", (F.col("first") + F.col("i")).alias("first")
    )
    order = F.struct("none", *KEYS, "first")
    firsts = cut(
        each.groupBy("window")
        .agg(F.min(order).alias("home"), F.max(order).alias("end"))
        .filter("home < end")
        .select("window", "home")
    )
    own = F.struct("none", *KEYS) == F.struct("home.none", *[f"home.{k}" for k in KEYS])
    many = (
        each.join(firsts.hint("merge"), "window")
        .filter((order > F.col("home")) & (~own | (F.col("first") >= F.col("home.first") + run)))
        .select(*KEYS, F.col("first").alias("begin"), (F.col("first") + run).alias("end"))
    )
    return (
        few.unionByName(many)
        .groupBy(*KEYS)
        .agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("gone"))
    )


def dedup_lines(docs: DataFrame, run: int = RUN, line: int = LINE) -> DataFrame:
    """``docs`` without later repeated passages in ``text``, with ``n_lines`` before and ``n_removed``,
    the number of lines that lost all or some of their words."""

    @F.arrow_udf("struct<text: string, lost: int>")
    def rest(text: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
        done = [
            None if t is None else without(t, b, e)
            for t, b, e in zip(text.to_pylist(), begins.to_pylist(), ends.to_pylist())
        ]
        return pa.StructArray.from_arrays(
            [
                pa.array([d and d[0] for d in done], pa.string()),
                pa.array([d and d[1] for d in done], pa.int32()),
            ],
            ["text", "lost"],
        )

    gone = cut(repeated_runs(docs, run, line)).withColumnRenamed("gone", "__gone")
    # The list grows with the documents, so it is shuffled at every size.
    rows = keyed(docs).join(gone.hint("merge"), KEYS, "left")
    hit = F.col("__gone").isNotNull()
    rows = rows.withColumn(
        "__rest", rest(F.when(hit, F.col("text")), F.col("__gone.begin"), F.col("__gone.end"))
    )
    body = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(
        *[c for c in docs.columns if c not in ("text", "n_lines", "n_removed")],
        (F.regexp_count(body, F.lit("\n")) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.col("__rest.lost"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(hit, F.col("__rest.text")).otherwise(F.col("text")).alias("text"),
    )


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
