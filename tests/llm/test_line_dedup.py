import random

from flowloom.llm import line_dedup as ld


def removed(df, **kw):
    return {r["doc_id"]: (r["text"], r["n_removed"]) for r in ld.dedup_lines(df, **kw).collect()}


def line(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def kept_words(text, lost):
    return [w for k, w in enumerate((text or "").split()) if k not in lost]


def test_equals_brute_force_on_shuffled_passages(make):
    rng = random.Random(2)
    passages = [[line(rng, rng.choice([3, 13, 25, 60])) for _ in range(rng.randrange(1, 7))] for _ in range(8)]
    common = line(rng, 13)
    rows = []
    for i in range(60):
        body = []
        for _ in range(rng.randrange(1, 5)):
            part = rng.choice(passages)
            at = rng.randrange(len(part))
            body += part[at : at + rng.randrange(1, 7)]
            body += rng.choice([[], [""], [common], [line(rng, 20)], ["  " + common + " "]])
        rows.append((i, "\n".join(body)))
    gone = by_words(rows)
    assert sum(map(len, gone)) > 1000
    got = removed(make(rows))
    for (i, text), lost in zip(rows, gone):
        assert got[i][0].split() == kept_words(text, lost)
        assert (got[i][1] > 0) == bool(lost)


def test_first_occurrence_stays_and_short_runs_stay(make):
    rng = random.Random(4)
    long, short = line(rng, 55), line(rng, 40)
    got = removed(make([(3, f"a\n{long}\nb"), (1, f"{long}\nc"), (2, short), (4, short), (5, f"{long}\n{long}")]))
    assert got[1] == (f"{long}\nc", 0) and got[3] == ("a\nb", 1) and got[5] == ("", 2)
    assert got[2] == got[4] == (short, 0)


def earlier_runs(rows, run=50):
    """The first place of every window of words, as document and position."""
    first = {}
    for d in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        words = (rows[d][1] or "").split()
        for i in range(len(words) - run + 1):
            first.setdefault(tuple(words[i : i + run]), (d, i))
    return first


def test_every_removed_run_still_stands_earlier_in_the_corpus(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    after = {r["doc_id"]: r["text"] for r in ld.op9(spark, sf).collect()}
    first, gone = earlier_runs(rows), by_words(rows)
    homes = {w: 0 for w, (d, i) in first.items() if not gone[d] & set(range(i, i + 50))}
    assert len(after) == len(rows) and sum(map(len, gone)) > 1000
    for (i, text), lost in zip(rows, gone):
        words = (text or "").split()
        assert after[i].split() == kept_words(text, lost)
        for k in range(len(words) - 49):
            if lost.issuperset(range(k, k + 50)) and tuple(words[k : k + 50]) in homes:
                homes[tuple(words[k : k + 50])] += 1
    # Runs were removed whose first place is untouched.
    assert sum(n > 0 for n in homes.values()) > 100


def test_edges(edge, empty):
    rows = ld.dedup_lines(edge).collect()
    texts = {(r["doc_id"], r["text"]) for r in rows}
    assert {(2, None), (3, ""), (4, " \t\n\x0b "), (None, None)} <= texts
    assert sum(1 for r in rows if r["text"] and r["text"].startswith("line 0 ")) == 2  # rows of id 5, one document
    assert (6, "one more line at the end") in texts and (None, "") in texts
    assert sorted(set(edge.columns) | {"n_lines", "n_removed"}) == sorted(ld.dedup_lines(edge).columns)
    assert ld.dedup_lines(empty).collect() == []


def by_words(rows, run=50):
    """Word positions removed per document: those of windows with an earlier equal one that they do not overlap."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    first, gone = {}, [set() for _ in rows]
    for d in order:
        words = (rows[d][1] or "").split()
        for i in range(len(words) - run + 1):
            e, other = first.setdefault(tuple(words[i : i + run]), (d, i))
            if e != d or i >= other + run:
                gone[d].update(range(i, i + run))
    return gone


def test_passages_inside_lines_go(make):
    rng = random.Random(6)
    passages = [line(rng, n).split() for n in (49, 50, 51, 52, 60, 90, 140)]
    rows = []
    for i in range(50):
        words = line(rng, rng.randrange(30)).split()
        for p in rng.sample(passages, 3):
            words += p + line(rng, rng.randrange(1, 30)).split()
        rows.append((i, "".join(w + ("\n" if rng.random() < 0.02 else " ") for w in words)))
    gone = by_words(rows)
    assert sum(map(len, gone)) > 3000
    got = removed(make(rows))
    for (i, text), lost in zip(rows, gone):
        assert got[i][0].split() == [w for k, w in enumerate(text.split()) if k not in lost]
        assert (got[i][1] > 0) == bool(lost)


def test_a_passage_in_a_long_line_leaves_the_rest_of_it(make):
    rng = random.Random(7)
    p, a, b, c, d = (line(rng, n) for n in (51, 30, 31, 32, 33))
    got = removed(make([(1, f"{a} {p} {b}"), (2, f"x\n{c}  {p} {d}\ny"), (3, f"{p} {c}\n{d} {p}")]))
    assert got[1] == (f"{a} {p} {b}", 0)
    assert got[2] == (f"x\n{c}  {d}\ny", 1)
    assert got[3] == (f"{c}\n{d}", 2)


def test_a_loop_keeps_its_first_window(make):
    loop = " ".join(f"k{i % 3}" for i in range(200))
    text, n = removed(make([(1, loop)]))[1]
    assert n == 1 and 50 <= len(text.split()) < 53 and loop.startswith(text)


def test_given_table_equals_brute_force_by_words(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    gone = by_words(rows)
    got = {r["doc_id"]: r["text"] for r in ld.op9(spark, "/root/testdata/sf0.01").collect()}
    for (i, text), lost in zip(rows, gone):
        assert got[i].split() == [w for k, w in enumerate(text.split()) if k not in lost]


def test_fingerprints_of_many_documents_give_the_same(make, monkeypatch):
    rng = random.Random(8)
    passages = [line(rng, n).split() for n in (50, 55, 80)]
    rows = [
        (i, " ".join(line(rng, 5).split() + rng.choice(passages)[rng.randrange(3) :] + rng.choice(passages)))
        for i in range(30)
    ]
    monkeypatch.setattr(ld, "GROUP", 3)
    got = removed(make(rows))
    for (i, text), lost in zip(rows, by_words(rows)):
        assert got[i][0].split() == [w for k, w in enumerate(text.split()) if k not in lost]


def test_stretches_that_meet_other_homes(make):
    """A passage that shares a fingerprint with one document and its surroundings with another."""
    rng = random.Random(9)
    core = line(rng, 20).split()
    sides = [(line(rng, 45).split(), line(rng, 45).split()) for _ in range(4)]
    rows = []
    for i in range(40):
        left, right = rng.choice(sides)[0], rng.choice(sides)[1]
        words = line(rng, 3).split() + left[rng.randrange(40) :] + core + right[: rng.randrange(5, 45)] + line(rng, 3).split()
        rows.append((i, " ".join(words)))
    gone = by_words(rows)
    assert sum(map(len, gone)) > 500
    got = removed(make(rows))
    for (i, text), lost in zip(rows, gone):
        assert got[i][0].split() == kept_words(text, lost)


def test_loops_across_documents(make):
    loops = [" ".join(f"k{i % p}" for i in range(n)) for p, n in ((3, 300), (3, 90), (1, 400), (60, 260), (7, 52))]
    rows = [(i, f"{a} x{i} {b}") for i, (a, b) in enumerate((a, b) for a in loops for b in loops)]
    got = removed(make(rows))
    for (i, text), lost in zip(rows, by_words(rows)):
        assert got[i][0].split() == kept_words(text, lost)


def test_matches_are_extended_both_ways():
    import numpy as np

    own, home = np.arange(100, dtype=np.uint32), np.arange(90, 200, dtype=np.uint32)
    assert ld.extended(own, 95, home, 5) == (90, 100)
    assert ld.extended(own, 95, own, 94) == (95, 95)
    other = own.copy()
    other[[10, 70]] = 1000
    assert ld.extended(own, 40, other, 40) == (11, 70)
