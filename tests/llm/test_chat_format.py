import pytest

from flowloom.llm import chat_format as cf

ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "ann", "Hello"), (1, 2, "bob", "Hi ann"), (1, 3, "ann", "Bye"),
    (2, 0, "system", "nobody here"), (3, 1, None, None), (3, 0, "", "first"), (3, None, "x\ny", "<|im_end|>"),
    (None, 0, "ann", "lost"), (4, 0, "ann", "same"), (4, 0, "ann", "same"),
]


def render(spark, rows, part=cf.PART, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {(r["conv_id"], r["speaker"], r["part"]): r for r in cf.render(cf.rotate(df, **kw), part).collect()}


def covered(row):
    return [row["text"][s["begin"] : s["end"]] for s in row["spans"]]


def test_every_participant_is_the_assistant_once(spark):
    got = render(spark, ROWS)
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (3, "unknown", 0), (3, "x y", 0), (None, "ann", 0), (4, "ann", 0)}
    bob = got[1, "bob", 0]
    assert bob["text"] == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=ann\nHello<|im_end|>\n"
        "<|im_start|>assistant\nHi ann<|im_end|>\n<|im_start|>user name=ann\nBye<|im_end|>\n"
    )
    assert covered(bob) == ["Hi ann<|im_end|>"]
    assert covered(got[1, "ann", 0]) == ["Hello<|im_end|>", "Bye<|im_end|>"]
    assert covered(got[4, "ann", 0]) == ["same<|im_end|>"] * 2


def test_odd_rows(spark):
    got = render(spark, ROWS)
    odd = got[3, "x y", 0]
    assert odd["text"].startswith("<|im_start|>assistant\n<| im_end|><|im_end|>\n<|im_start|>user name=unknown\nfirst")
    assert covered(got[3, "unknown", 0]) == ["first<|im_end|>", "<|im_end|>"]
    assert render(spark, ROWS[:0]) == {}


def test_long_conversations_come_in_parts(spark):
    rows = [(7, i, "ann" if i % 3 else "bob", f"text é {i}") for i in range(25)]
    got = render(spark, rows, part=10, rows_per_task=4)
    assert {k for k in got if k[1] == "bob"} == {(7, "bob", p) for p in range(3)}
    assert [got[7, "bob", p]["n_turns"] for p in range(3)] == [10, 10, 5]
    spoken = [x for p in range(3) for x in covered(got[7, "bob", p])]
    assert spoken == [f"text é {i}<|im_end|>" for i in range(0, 25, 3)]


LONG_TALK = [
    (7, i, "system" if i in (0, 12, 20) else "ann" if i % 3 else "bob", f"text é {i}") for i in range(35)
] + [(None, i, "system" if i == 3 else "eve", "x" * 5000) for i in range(11)]


def test_later_parts_open_with_the_system_turn_before_them(spark):
    got = render(spark, LONG_TALK, part=10, rows_per_task=4)
    system = [got[7, "bob", p]["text"].split("<|im_end|>")[0] for p in range(4)]
    assert system == [f"<|im_start|>system\ntext é {i}" for i in (0, 0, 20, 20)]
    assert [got[7, "bob", p]["n_turns"] for p in range(4)] == [10, 10, 10, 5]
    assert [x for p in range(4) for x in covered(got[7, "bob", p])] == [
        f"text é {i}<|im_end|>" for i in range(0, 35, 3) if i not in (0, 12)
    ]
    assert got[None, "eve", 1]["text"].startswith("<|im_start|>system\nxxxx") and got[None, "eve", 1]["n_turns"] == 1


def test_parts_equal_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    con = duckdb.connect()
    con.register("rows", pd.DataFrame(LONG_TALK + ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE VIEW conversations AS SELECT * FROM rows")
    sql = cf.SQL.replace(f"// {cf.PART}", "// 10").replace(f"% {cf.PART}", "% 10")
    want = {(r[0], r[1], r[2]): r[3:] for r in con.execute(sql).fetchall()}
    got = render(spark, LONG_TALK + ROWS, part=10)
    spans = lambda r: ",".join(f"{s['begin']}-{s['end']}" for s in r["spans"]) or None
    assert {k: (r["n_turns"], r["text"], spans(r)) for k, r in got.items()} == want


def test_clashing_columns(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    more = df.withColumns({c: F.lit(1) for c in ("n", "body", "speaker", "own", "head", "part")})
    assert cf.render(cf.rotate(more)).count() == cf.render(cf.rotate(df)).count()
