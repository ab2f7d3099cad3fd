import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from flowloom.llm import fill_middle as fm

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """Form, units, output, and characters of prefix and middle, from the list of units."""
    text = text or ""
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return "plain", n, text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return "spm", n, f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return "psm", n, f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def check(rows, df, **kw):
    done = fm.fill_middle(df, **kw).withColumn("back", fm.restored(F.col("fim_text"), F.col("form"))).collect()
    want = sorted((str(i), *map(str, brute(i, t)), t or "") for i, t in rows)
    got = sorted(
        (str(r.doc_id), *map(str, (r.form, r.n_units, r.fim_text, r.prefix_chars, r.middle_chars)), r.back)
        for r in done
    )
    assert got == want
    return {r.form for r in done}


@pytest.mark.parametrize("block", [1, 3, 16, 2048])
def test_equals_units_written_out(make, block):
    rng = random.Random(3)
    parts = ["a", "né", "中文x", "🙂", " ", "\n", "\t ", "\x0b", " ", "<", "<P", "S>", "word"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(60)))) for i in range(200)]
    assert check(rows, make(rows), block=block) == {"plain", "psm", "spm"}


def test_marks_and_blank_texts(make):
    rows = [(i, t) for i, t in enumerate(["<P>", "a <S> b", "x<M>", " ", "\n\n", "", None, "one", "<<S", "M><"] * 12)]
    check(rows, make(rows))


def test_edges(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    check(rows, edge)
    clash = edge.withColumn("form", F.lit(1)).withColumn("fim_text", F.lit(2))
    out = fm.fill_middle(clash)
    assert len(set(out.columns)) == len(out.columns) and out.count() == len(rows)
    assert fm.fill_middle(empty).collect() == []


def test_one_very_long_word_and_many_units(make):
    rows = [(i, t) for i, t in enumerate(["é" * 70_000, "a " * 50_000, " " * 5_000 + "x" + "\n" * 5_000] * 6)]
    check(rows, make(rows))


def test_tree_finds_the_block_of_each_unit():
    rng = random.Random(1)
    for size in (1, 2, 3, 7, 8, 9, 33):
        units = [rng.randrange(4) for _ in range(size)]
        tree = fm.Fenwick(units, [2 * u + 1 for u in units])
        owner = [b for b, u in enumerate(units) for _ in range(u)]
        for k, b in enumerate(owner, 1):
            assert tree.before(k) == (b, sum(units[:b]), sum(2 * u + 1 for u in units[:b]))
