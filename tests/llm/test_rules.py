import re

from pyspark.sql import functions as F

from flowloom.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = {}, set()
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_figures_equal_brute_force(edge, make):
    loop = " ".join(f"k{i % 9}" for i in range(60))
    docs = edge.select("doc_id", "text", "source").unionByName(
        make([(50, loop), (51, "a b c d e f g h a b c d e f g h i"), (52, "x\nx\n\n \nx y\r\nx")]).select("doc_id", "text", "source")
    )
    for r in qr.figures(docs).collect():
        assert tuple(r[n] for n in NAMES) == brute(r["text"])


def test_a_bad_host_goes_with_its_documents(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"{good} {i}", "fine") for i in range(60)]
    rows += [(100 + i, "too short", "bad") for i in range(57)] + [(200, good + " last", "bad")]
    rows += [(300, good + " alone", None)]
    kept = {r["doc_id"] for r in qr.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("kept").collect()}
    assert kept == set(range(60)) | {300}


def test_small_hosts_are_shrunk(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1000 * h + i, f"{good} {h} {i}" if i >= h % 3 else "short", f"h{h}") for h in range(30) for i in range(20)]
    rows += [(1, good, "tiny"), (2, "short", "tiny"), (3, "short", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rate = {r["source"]: r["few_words_rate"] for r in qr.host_verdicts(qr.failures(qr.figures(df))).collect()}
    assert rate["tiny"] < 2 / 3
    assert 1 in {r["doc_id"] for r in qr.keep_good(df).collect()}


def test_edges_keep_their_columns(edge, empty):
    kept = qr.keep_good(edge)
    assert kept.columns == edge.columns
    assert kept.filter(F.col("kept") != "x").count() == 0
    assert 7 in {r["doc_id"] for r in kept.collect()} or brute(edge.filter("doc_id = 7").first()["text"])[4] > 0
    assert qr.keep_good(empty).collect() == []
    assert qr.judge(empty).collect() == []


def test_failures_are_charged_by_the_host(spark):
    """One broken rule is forgiven at a clean host and counts elsewhere; clean documents stay everywhere."""
    good = " ".join(f"word{i}" for i in range(40))
    noisy = good + " ## $$ %% && **"
    rows = [(i, f"{good} {i}", "clean") for i in range(400)] + [(1000, noisy, "clean")]
    rows += [(2000 + i, f"{noisy if i % 3 == 0 else good} {i}", "noisy") for i in range(90)]
    rows += [(3000, noisy, None), (3001, good, None)]
    # The same noise and repeated lines too.
    both = "\n".join([noisy] + ["one line of some words"] * 8)
    rows += [(4000, both, "clean")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in qr.judge(df).filter("kept").collect()}
    clean = set(range(400)) | {2000 + i for i in range(90) if i % 3} | {3001}
    assert kept - {4000} == clean | {1000}
    rates = {r["source"]: r["symbols_charge"] for r in qr.host_verdicts(qr.failures(qr.figures(df))).collect()}
    assert rates["clean"] < qr.CHARGE < 1 < rates["noisy"]


def test_verdict_takes_junk_of_the_given_tables_and_leaves_good_texts(spark):
    for scale in ("sf0.01", "sf0.1"):
        sf = f"/root/testdata/{scale}"
        labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
        judged = qr.op3(spark, sf).filter("NOT base_failed").join(labels, "doc_id").filter("quality IS NOT NULL")
        n = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
        assert n[0, False] >= 20
        assert n.get((1, False), 0) <= 0.01 * n[1, True]
