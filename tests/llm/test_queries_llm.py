"""Queries of this package that SQL can express, the pipeline, and the registry."""

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from flowloom.llm import decontaminate, near_dedup, plans
from flowloom.llm.common import table
from flowloom.operators.lineage import cut
from oracle import connect, differences
from test_line_dedup import by_words

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert differences(plans.QUERIES[name](spark, SF), duck, plans.ORACLES[name]) == []


def test_one_query_for_each_operator():
    names = contract.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run


@pytest.fixture(scope="module")
def stages(spark):
    docs, done = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, SF))
        done.append((name, before, docs))
    return done


def test_stages_return_documents(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_quality_stage_takes_out_what_fails(stages, spark):
    _, before, after = stages[0]
    kept = {r["doc_id"] for r in plans.QUERIES["op3_quality_rules"](spark, SF).filter("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept


def test_line_stage_takes_out_later_runs_only(stages):
    _, before, after = stages[1]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = {i: [w for k, w in enumerate(text.split()) if k not in lost] for (i, text), lost in zip(rows, by_words(rows))}
    got = {r["doc_id"]: r for r in after.collect()}
    assert {i: r["text"].split() for i, r in got.items()} == {i: w for i, w in want.items() if w}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_near_copy_stage_leaves_no_link(stages):
    _, before, after = stages[2]
    again = near_dedup.near_duplicates(after, 5)
    assert again.filter("NOT kept").count() == 0
    parts = near_dedup.near_duplicates(before, 5)
    assert after.count() == parts.select("component_id").distinct().count()


def test_benchmark_stage(stages, spark):
    _, before, after = stages[3]
    judged = decontaminate.contamination(before, table(spark, SF, "benchmark"))
    assert after.count() == judged.filter("NOT contaminated").count()


def test_mixture_takes_from_what_was_kept(stages):
    _, before, after = stages[4]
    ids = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert ids[r["doc_id"]] == r["text"] and 0 <= r["first_word"] < r["last_word"] <= len(r["text"].split())


def test_run_goes_through_all_stages(stages, spark):
    _, _, after = stages[4]
    assert corpus_pipeline.run(spark, SF).count() == after.count()
