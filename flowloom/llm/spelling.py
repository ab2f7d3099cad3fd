"""Spelling variants: words one letter apart, each led to the form that is used most.

Words that may be near are brought together by what they must share.  If two words
differ by one inserted, deleted or replaced letter and the shorter has ``m``
letters, what they have in common at the front and at the back is at least
``m - 1`` letters long.  So they agree in the first or in the last half of that, and
inside the rest again, and so on: a *view* of a word is what it keeps at both ends
once no more than ``FREE`` letters are left free (after ``LEVELS`` halvings at
most), and near words share a view.  Words of one view and length are a group.

A task goes through its groups in blocks of words and holds a bit-sliced index of the
block: for each position and letter a set of words, one bit for each word.  All words
of a block are then read against all of it letter by letter, in whole machine words of
bits.  Three sets are kept for each word that is read:

* no error so far: the set before, and those with this letter at this position;
* one letter replaced: the set before with this letter here, or no error so far and another
  letter here;
* one letter more than the word read: the set before with this letter one position on, where
  words without an error may have entered by leaving out a letter.

At the end of a word the last two sets, of the right length, are its near words; a
letter less is the same pair from the other side.

No group is too large for a task: words of a group differ only in its free letters,
and a group that overfills a block is read against several indexes.  Long words stop
at ``LEVELS`` halvings, since there is a view for each way of halving.

NULL and empty texts have no words; a NULL ``doc_id`` is read as an empty one.
Repeated rows count each time.  An empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import CAPITALS, query, table
from flowloom.llm.sharding import crc32_sql
from flowloom.operators.lineage import Rounds, cut

SHORTEST = 7
LEAST = 2
TIMES = 10
DELETE_EVERY = 31
FREE = 2
LEVELS = 4
# Words in an index, and the most letters of all its words.
BLOCK = 1024
LETTERS = 1 << 20
WORDS_PER_TASK = 20_000
# A worker's tally is handed on when it has this many entries.
TALLY = 200_000

# Fixed value: the letters of a word, in lower case as far as A-Z go.
_RUN = "[a-zÀ-ÿ]{%d,}"


def _strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, every: int = DELETE_EVERY) -> DataFrame:
    """``word`` and ``n``: runs of letters, some with a letter deleted as ``doc_id`` and run decide."""
    run = re.compile(_RUN % shortest)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [_strings(list(seen.keys())), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for doc_id, value in zip(batch.column("id").to_pylist(), batch.column("text")):
                start = zlib.crc32(f"{doc_id}:".encode())
                # Bytes are put in lower case from A to Z only.
                for word, n in Counter(run.findall(value.as_py().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    seen[word] += n
                if len(seen) > TALLY:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return (
        docs.filter("text <> ''")
        .select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("text"))
        .mapInArrow(tally, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least)
    )


@lru_cache(maxsize=4096)
def views(m: int, free: int = FREE, levels: int = LEVELS) -> tuple[tuple[int, int], ...]:
    """Letters kept at the front and at the back in each view, for a shorter word of ``m`` letters."""
    found = [(0, 0)]
    for _ in range(levels):
        done = []
        for front, back in found:
            left = m - front - back
            half = left // 2  # the larger half of the left - 1 letters that are shared there
            done += [(front, back)] if left <= free else [(front + half, back), (front, back + half)]
        if done == found:
            break
        found = done
    return tuple(dict.fromkeys(found))


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word and view, as the shorter and as the longer word of a pair."""
    for batch in batches:
        words, keys, lengths, rows = batch.column("word").to_pylist(), [], [], []
        for k, word in enumerate(words):
            size = len(word)
            for m in (size - 1, size):
                for front, back in views(m):
                    name = f"{m}.{front}.{word[:front]}.{word[size - back:]}"
                    keys.append(xxhash.xxh3_64_intdigest(name) - (1 << 63))
                    lengths.append(m)
                    rows.append(k)
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()),
                pa.array(lengths, pa.int32()),
                batch.column("word").take(take),
                batch.column("n").take(take),
            ],
            ["view", "m", "word", "n"],
        )


class Index:
    """Which of up to ``BLOCK`` words have a letter at a position, as bits, by position and letter."""

    def __init__(self, letters: np.ndarray, longer: np.ndarray, alphabet: int) -> None:
        """``letters`` has a row for each word, one column more than the shorter ones have, filled with -1."""
        n, width = letters.shape
        self.words = -(-n // 64)
        place, bit = np.arange(n) // 64, np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.at = np.zeros((width, alphabet, self.words), np.uint64)
        for position in range(width):
            there = np.flatnonzero(letters[:, position] >= 0)
            np.bitwise_or.at(self.at[position], (letters[there, position], place[there]), bit[there])
        self.all, self.longer = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        np.bitwise_or.at(self.all, place, bit)
        np.bitwise_or.at(self.longer, place[longer], bit[longer])

    def near(self, queries: np.ndarray) -> np.ndarray:
        """The words one letter from each query of the shorter length, as rows of bits."""
        n, m = queries.shape
        exact = np.broadcast_to(self.all, (n, self.words)).copy()
        replaced, more = np.zeros_like(exact), np.zeros_like(exact)
        for i in range(m):
            here, next_one = self.at[i][queries[:, i]], self.at[i + 1][queries[:, i]]
            more = (more | exact) & next_one
            replaced = (replaced & here) | (exact & ~here)
            exact &= here
        return (replaced & ~self.longer) | ((more | exact) & self.longer)


def bits(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bit number of every bit that is set."""
    rows, places = np.nonzero(found)
    octets = found[rows, places].astype("<u8").view(np.uint8).reshape(-1, 8)
    which, bit = np.nonzero(np.unpackbits(octets, axis=1, bitorder="little"))
    return rows[which], places[which] * 64 + bit


def near_pairs(words: list[str], groups: np.ndarray, m: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near words of one group, as (one of length ``m``, one of ``m`` or ``m + 1``).

    ``words`` are of these lengths; those of one group stand together.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    known, codes = np.unique(points, return_inverse=True)
    letters = np.full((len(words), m + 1), -1, np.int32)
    letters[np.arange(m + 1) < sizes[:, None]] = codes
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[starts[1:], len(words)]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    most = max(64, min(block, LETTERS // (m + 1)))
    first = 0
    while first < len(starts):
        # Whole groups up to a block; a larger one by itself.
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + most, "right")))
        a, b = starts[first], ends[last - 1]
        for i in range(a, b, most):
            index = Index(letters[i : min(i + most, b)], sizes[i : min(i + most, b)] > m, len(known))
            for j in range(a, b, most):
                ask = j + np.flatnonzero(sizes[j : min(j + most, b)] == m)
                if len(ask):
                    x, y = bits(index.near(letters[ask, :m]))
                    x, y = ask[x], y + i
                    same = groups[x] == groups[y]
                    left.append(x[same])
                    right.append(y[same])
        first = last
    return np.concatenate(left), np.concatenate(right)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words from rows sorted by length and view; each pair both ways."""
    words, counts, keys, now = [], [], [], None

    def out() -> Iterator[pa.RecordBatch]:
        # Most views have one word only, which needs no index.
        groups = np.array(keys, np.int64)
        same = groups[1:] == groups[:-1]
        kept = np.flatnonzero(np.r_[False, same] | np.r_[same, False]).tolist()
        words[:], counts[:] = [words[k] for k in kept], [counts[k] for k in kept]
        a, b = near_pairs(words, groups[kept], now) if kept else ((), ())
        if len(a):
            other = np.fromiter((len(words[k]) > now for k in b), bool, len(b))
            a, b = np.r_[a, b[other]], np.r_[b, a[other]]
            yield pa.RecordBatch.from_arrays(
                [
                    _strings([words[k] for k in a]),
                    _strings([words[k] for k in b]),
                    pa.array([counts[k] for k in b], pa.int64()),
                ],
                ["word", "near", "near_n"],
            )
        words.clear(), counts.clear(), keys.clear()

    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("view", "m", "word", "n")])
        for view, m, word, n in rows:
            if m != now:
                if words:
                    yield from out()
                now = m
            elif len(words) >= 4 * BLOCK and view != keys[-1]:
                yield from out()
            words.append(word)
            counts.append(n)
            keys.append(view)
    if words:
        yield from out()


def near_words(vocab: DataFrame) -> DataFrame:
    """``word``, ``near`` and ``near_n`` of all pairs of words one letter apart, both ways."""
    tasks = vocab.count() // WORDS_PER_TASK + 1
    # The words are few bytes but much work, so tasks are counted in words.
    seen = vocab.select("word", "n").repartition(tasks, "word").mapInArrow(
        _views, "view long, m int, word string, n long"
    )
    return (
        seen.repartition(tasks, "view")
        .sortWithinPartitions("m", "view")
        .mapInArrow(_pairs, "word string, near string, near_n long")
        .distinct()
    )


def roots(links: DataFrame) -> DataFrame:
    """``word`` and ``root`` from ``word`` and ``form``: each round doubles the steps followed."""
    state = Rounds()
    now = state.step(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = state.step(
            now.join(ahead, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            moved=F.count(F.when(F.col("moved"), 1)),
        )
        if not state.facts["moved"]:
            return now.select("word", "root")
        now = now.drop("moved")


def variants(vocab: DataFrame, times: int = TIMES) -> DataFrame:
    """``word``, ``n``, ``form``, ``root``, ``n_near`` and ``form_n`` of a vocabulary of ``word`` and ``n``.

    A form is used at least ``times`` as often as its word, so following forms ends.
    """
    vocab = cut(vocab)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    found = near_words(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    words = cut(
        vocab.join(found, "word", "left").select(
            "word",
            "n",
            F.when(fits, F.col("best.form")).alias("form"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, -F.col("best.less")).alias("form_n"),
        )
    )
    led = roots(words.filter("form IS NOT NULL").select("word", "form"))
    return words.join(led, "word", "left").withColumn("root", F.coalesce("root", "word"))


_LONG = "[a-z\\x{C0}-\\x{FF}]{%d,}" % SHORTEST

SQL = f"""
WITH RECURSIVE r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
    unnest(regexp_extract_all(translate(text, '{CAPITALS}', '{CAPITALS.lower()}'), '{_LONG}')) AS run
  FROM documents
), c AS (
  SELECT id, run, count(*) AS k FROM r GROUP BY id, run
), h AS (
  SELECT run, k, {crc32_sql("encode(id || ':' || run)")} AS h FROM c
), w AS (
  SELECT CASE WHEN h % {DELETE_EVERY} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
    ELSE run END AS word, k FROM h
), v AS (
  SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(k) >= {LEAST}
), d AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT v.word, d.word, d.n FROM v JOIN d ON v.word = d.rest
  UNION SELECT d.word, v.word, v.n FROM v JOIN d ON v.word = d.rest
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN near_n >= {TIMES} * n THEN near END AS form, CASE WHEN near_n >= {TIMES} * n THEN near_n END AS form_n
  FROM v LEFT JOIN best USING (word)
), t AS (
  SELECT word, word AS root, 0 AS steps FROM f
  UNION ALL SELECT t.word, f.form, steps + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(root, steps) AS root FROM t GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""


@query("op12_spelling_variants", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(vocabulary(docs)).select("word", "form", "root", "n", "n_near", "form_n")
