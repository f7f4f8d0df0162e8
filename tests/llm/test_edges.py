"""Every operator over nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import (
    fingerprints, html_text, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, toxicity, url_filter,
)


def sited(d):
    return d.select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))


BY_DOCUMENT = {
    "fingerprints": lambda d, l: fingerprints.fingerprints(d),
    "mixing": lambda d, l: mixing.mixture(d),
    "pii": lambda d, l: pii.found(d),
    "near_dedup": lambda d, l: near_dedup.near_duplicates(d),
    "quality_rules": lambda d, l: quality_rules.judged(d, l),
    "toxicity": lambda d, l: toxicity.scored(d, toxicity.trained(d, l, toxicity.Settings(steps=20))),
    "quality_classifier": lambda d, l: quality_classifier.classified(sited(d), l),
}


def canonical(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_one_row_for_each_document(name, edge_docs, clashing, labels, edge_rows):
    run = BY_DOCUMENT[name]
    rows = run(edge_docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in edge_rows)
    assert canonical(run(clashing, labels).collect()) == canonical(rows)


@pytest.mark.parametrize("name", ["quality_rules", "toxicity", "quality_classifier"])
def test_clashing_columns_of_labels(name, edge_docs, labels):
    more = labels.select("*", *[F.lit(f"extra {c}").alias(c) for c in ("text", "id", "good", "n", "own", "h", "t", "host", "path", "grams", "held", "source")])
    assert canonical(BY_DOCUMENT[name](edge_docs, more).collect()) == canonical(BY_DOCUMENT[name](edge_docs, labels).collect())


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_empty_tables(name, no_docs, edge_docs, labels, no_labels):
    run = BY_DOCUMENT[name]
    assert run(no_docs, labels).collect() == []
    if name in ("quality_rules", "toxicity", "quality_classifier"):
        assert run(edge_docs, no_labels).count() == edge_docs.count()


def test_packing_edges(edge_docs, clashing, no_docs, edge_rows):
    rows = packing.packed(edge_docs).collect()
    assert canonical(packing.packed(clashing).collect()) == canonical(rows)
    assert packing.packed(no_docs).collect() == []
    assert {str(r["doc_id"]) for r in rows} == {str(r[0]) for r in edge_rows}
    whole = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert whole[1] == whole[2] == 1


STAGES = {
    "rules": lambda d, l: quality_rules.kept_documents(d, l),
    "near_dedup": lambda d, l: near_dedup.deduplicated(d),
    "pii": lambda d, l: pii.redacted(d),
    "mixing": lambda d, l: mixing.mixed_documents(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_all_columns(name, edge_docs, clashing, no_docs, labels):
    stage = STAGES[name]
    for docs in (edge_docs, clashing):
        out = stage(docs, labels)
        assert out.columns == docs.columns and 0 < out.count()
    assert stage(no_docs, labels).collect() == []


def test_html_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "<p>a", "x"), (3, "<div>" * 5000 + "deep", "x"), (3, "<div>" * 5000 + "deep", "x"), (4, "<!-- open", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = sorted((str(r["page_id"]), r["text"]) for r in html_text.extracted(pages).collect())
    assert out == [("1", ""), ("2", ""), ("3", "deep"), ("3", "deep"), ("4", ""), ("None", "a")]
    assert html_text.extracted(pages.limit(0)).collect() == []


def test_url_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (None, "http://A.NET/x?y#z"), (5, "ftp://x.net"), (6, "http://" + "a" * 50_000 + "/b"), (6, "http://q.org/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("grams", F.lit(1))
    out = {(r["page_id"], r["host"][:9]): r for r in url_filter.judged_urls(pages, url_filter.labelled_table(spark)).collect()}
    assert len(out) == len(rows)
    assert out[(None, "a.net")]["rule"] == "net/" and out[(None, "a.net")]["verdict"] == "block" and out[(None, "a.net")]["path"] == "/x"
    assert out[(5, "x.net")]["rule"] is None  # no path, so that no rule's path begins it
    assert out[(1, "")]["path"] == "" and out[(3, "")]["host"] == ""
    assert out[(6, "q.org")]["verdict"] == "allow"
    assert url_filter.judged_urls(pages.limit(0), url_filter.labelled_table(spark)).collect() == []
    none = url_filter.labelled_table(spark).limit(0)
    assert set(url_filter.trained(none)) == {0.0}
    assert {r["verdict"] for r in url_filter.judged_urls(pages, none).where("rule IS NULL").collect()} == {"allow"}


def test_keeping_rules_edges(edge_docs, labels):
    got = {r["doc_id"]: r for r in quality_rules.judged(edge_docs, labels).collect() if r["doc_id"] in (1, 2, 3, 4)}
    assert all(r["base_failed"] and not r["kept"] for r in got.values())
    assert got[4]["n_words"] == 1 and got[3]["n_words"] == 0
