"""The pipeline's stages in a row, and what the native operators' plans hold."""

import re

import pytest

import corpus_pipeline
from tessera.llm import near_dedup, pii, quality_rules, queries
from tessera.llm.common import saved

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    tables, docs = {}, first
    for name, stage in corpus_pipeline.STAGES:
        docs = tables[name] = saved(stage(spark, docs, SF))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "pii", "mixing", "packing"]
    assert all(tables[n].columns == first.columns for n in list(tables)[:-1])
    ids = {n: [r["doc_id"] for r in t.select("doc_id").collect()] for n, t in tables.items()}
    judged = {r["doc_id"] for r in quality_rules.judged(first, labels).where("kept").collect()}
    assert set(ids["quality_rules"]) == judged
    alone = {r["doc_id"] for r in near_dedup.near_duplicates(tables["quality_rules"]).where("kept").collect()}
    assert set(ids["near_dedup"]) == alone == set(ids["pii"])
    weights = pii.trained()
    before = {r["doc_id"]: r["text"] for r in tables["near_dedup"].collect()}
    for r in tables["pii"].collect():
        assert r["text"] == pii.masked(before[r["doc_id"]], pii.all_spans(before[r["doc_id"]], weights)[1]) and r["n_chars"] == len(r["text"])
    assert set(ids["mixing"]) <= set(ids["pii"]) and max(map(ids["mixing"].count, set(ids["mixing"]))) <= 3
    pieces = tables["packing"].collect()
    whole = sum(r["length"] for r in pieces)
    assert whole == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    assert sum(1 for r in pieces if r["start"] == 0) == len(ids["mixing"])


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns[:3] == ["doc_id", "start", "length"]


@pytest.mark.parametrize("name", ["op1_fingerprints", "op5_url_filter", "op9_quality_rules"])
def test_native_plans_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow|CartesianProduct", plan)


FILTERS = {
    "op1_fingerprints": "near_edited < 0.9 AND fingerprint <> ''", "op2_html_text": "n_lines > 3 AND text <> ''", "op3_packing": "length > 100",
    "op4_mixing": "taken > size", "op5_url_filter": "verdict = 'block' AND p_block > 0.1", "op6_quality_classifier": "kept AND evidence > 0",
    "op7_pii": "n_added > 0", "op8_near_dedup": "kept", "op9_quality_rules": "kept AND n_repeat_words > 0 AND evidence > -1", "op10_toxicity": "predicted = 1",
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_on_results_copy_no_work(spark, name):
    """A filter on a result's columns leaves the plan about as long, and gives the rows that have them."""
    whole = queries.QUERIES[name](spark, SF)
    some = whole.where(FILTERS[name])
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert size(some) < 1.5 * size(whole) + 2000
    assert some.count() <= whole.count()


def test_only_what_is_needed_is_read(spark):
    plan = queries.op5_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<page_id:bigint,url:string>", plan)
