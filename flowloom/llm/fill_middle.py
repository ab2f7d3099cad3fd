"""Fill-in-the-middle: texts cut in three and put in another order, and back again.

A text is its *units*: a word with the white space before it, and the white space
at the end if there is any.  Four numbers drawn from ``seed`` and ``doc_id`` say
whether a text is cut, before which units, and in which order the parts go.

Where a cut lies is found without listing the units of the text.  The text is
split into blocks of ``BLOCK`` bytes, and a Fenwick tree over the blocks holds how
many units end in each and how many code points begin there.  Descending the
tree by halving steps leads to the block in which the unit of a cut ends, with
both sums of what lies before it; only that block is then searched for the place.
A block may begin inside a character: places are bytes, which a unit never splits.

NULL and empty texts have no unit and stay as they are: form ``plain``, output
empty.  A text that holds one of the marks is plain too, so an output always
gives back its text.  A NULL ``doc_id`` draws like an empty one; equal ids draw
alike.  Rows are taken one by one: repeated rows give repeated rows.  Columns
named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import query, table

BLOCK = 2048
SEED = 42
# Of 100 texts, how many are cut, and of 100 cut ones, how many begin with the suffix.
CUT_RATE = 50
SUFFIX_FIRST_RATE = 80

# The marks before prefix, suffix and middle, and ASCII white space.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Fenwick:
    """Sums of units and of code points over the first blocks of a text."""

    def __init__(self, units: list[int], points: list[int]) -> None:
        size = len(units)
        self.units, self.points = [0, *units], [0, *points]
        for i in range(1, size + 1):
            parent = i + (i & -i)
            if parent <= size:
                self.units[parent] += self.units[i]
                self.points[parent] += self.points[i]
        self._top = 1 << (size.bit_length() - 1) if size else 0
        self.size = size

    def before(self, unit: int) -> tuple[int, int, int]:
        """Blocks wholly before the end of the ``unit``-th unit (from 1), and their sums."""
        at = units = points = 0
        step = self._top
        while step:
            to = at + step
            if to <= self.size and units + self.units[to] < unit:
                at = to
                units += self.units[to]
                points += self.points[to]
            step >>= 1
        return at, units, points


class Cuts:
    """Where the units of one text end, as bytes and as code points."""

    def __init__(self, data: np.ndarray, block: int = BLOCK) -> None:
        white = _WHITE[data]
        self._ends = ~white
        self._ends[:-1] &= white[1:]
        self._starts = (data & 0xC0) != 0x80
        self._block = block
        blocks = np.arange(0, len(data), block)
        units = np.add.reduceat(self._ends, blocks, dtype=np.int64) if len(data) else blocks
        points = np.add.reduceat(self._starts, blocks, dtype=np.int64) if len(data) else blocks
        self.end = (len(data), int(points.sum()))
        words = int(units.sum())
        self.n = words + int(len(data) > 0 and bool(white[-1]))
        self._tree = Fenwick(units.tolist(), points.tolist())

    def at(self, unit: int) -> tuple[int, int]:
        """Bytes and code points in the first ``unit`` units."""
        if unit <= 0:
            return 0, 0
        if unit >= self.n:
            return self.end
        blocks, units, points = self._tree.before(unit)
        start = blocks * self._block
        inside = np.flatnonzero(self._ends[start : start + self._block])[unit - units - 1] + 1
        return start + int(inside), points + int(np.count_nonzero(self._starts[start : start + inside]))


def rearranged(text: bytes, first: int, second: int, form: str, block: int = BLOCK) -> tuple:
    """Output, number of units, and code points of prefix and middle (None if plain)."""
    cuts = Cuts(np.frombuffer(text, np.uint8), block)
    if form == "plain":
        return text, cuts.n, None, None
    low, high = sorted((first % (cuts.n + 1), second % (cuts.n + 1)))
    (a, before), (b, upto) = cuts.at(low), cuts.at(high)
    prefix, middle, suffix = PREFIX.encode() + text[:a], MIDDLE.encode() + text[a:b], SUFFIX.encode() + text[b:]
    out = prefix + suffix + middle if form == "psm" else suffix + prefix + middle
    return out, cuts.n, before, upto - before


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight digits of the hash of seed and id, as numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_middle(
    docs: DataFrame,
    seed: int = SEED,
    cut_rate: int = CUT_RATE,
    suffix_first: int = SUFFIX_FIRST_RATE,
    block: int = BLOCK,
) -> DataFrame:
    """``docs`` with ``fim_text``, ``form`` (plain, psm, spm), ``n_units``, ``prefix_chars``, ``middle_chars``."""

    @F.arrow_udf("struct<text: string, n: long, prefix: long, middle: long>")
    def cut(text: pa.Array, first: pa.Array, second: pa.Array, form: pa.Array) -> pa.Array:
        columns = ([], [], [], [])
        for t, h1, h2, f in zip(text, first.to_pylist(), second.to_pylist(), form.to_pylist()):
            for column, value in zip(columns, rearranged(t.as_py(), h1, h2, f, block)):
                column.append(value)
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["text", "n", "prefix", "middle"]
        )

    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = (
        F.when((text == "") | marked | (h3 % 100 >= cut_rate), "plain")
        .when(h4 % 100 < suffix_first, "spm")
        .otherwise("psm")
    )
    results = ["fim_text", "form", "n_units", "prefix_chars", "middle_chars"]
    rows = docs.select(
        *[c for c in docs.columns if c not in results],
        form.alias("form"),
        cut(text.cast("binary"), h1, h2, form).alias("__cut"),
    )
    return rows.select(
        *[c for c in docs.columns if c not in results],
        F.col("__cut.text").alias("fim_text"),
        "form",
        F.col("__cut.n").alias("n_units"),
        F.col("__cut.prefix").alias("prefix_chars"),
        F.col("__cut.middle").alias("middle_chars"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""

    def parted(marks: list[str]) -> list[Column]:
        parts, rest = [], F.substr(output, F.lit(len(marks[0]) + 1))
        for mark in marks[1:]:
            part = F.substring_index(rest, mark, 1)
            parts.append(part)
            rest = F.substr(rest, F.char_length(part) + len(mark) + 1)
        return [*parts, rest]

    prefix, suffix, middle = parted([PREFIX, SUFFIX, MIDDLE])
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parted([SUFFIX, PREFIX, MIDDLE])
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || h[i : i + 7])::UBIGINT::BIGINT) AS draw
  FROM d
), c AS (
  SELECT *, len(units) AS n, least(draw[1] % (len(units) + 1), draw[2] % (len(units) + 1)) AS low,
    greatest(draw[1] % (len(units) + 1), draw[2] % (len(units) + 1)) AS high,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR draw[3] % 100 >= {CUT_RATE}
      THEN 'plain' WHEN draw[4] % 100 < {SUFFIX_FIRST_RATE} THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, array_to_string(units[1 : low], '') AS prefix, array_to_string(units[low + 1 : high], '') AS middle,
    array_to_string(units[high + 1 : n], '') AS suffix
  FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@query("op11_fill_middle", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("fim_text"), F.col("form"))
    return done.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("fim_text"), 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )
