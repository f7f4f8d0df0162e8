"""Registered retrieval queries on small tables where a cut would show."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.jobs import retrieval_queries as rq
from tessera.operators import catalog, lexical
from tessera.operators.search import Corpus, Options, search


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables, given as (rows, schema) by name, and returns their folder."""

    def write(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


DOCUMENTS, ITEMS = "doc_id long, text string, lang string, source string, n_chars long", "item_id long, text string"


def test_recall_notes_hold_the_hit_line(spark, tables):
    line = "the passage that tells of zebras " + "andmore" * 40
    text = "\n".join(["nothing of note here"] * 20 + [line])
    others = [(i, "quite other words", "en", "src1", 17) for i in range(2, 8)]
    sf = tables(documents=([(1, text, "en", "src0", len(text)), *others], DOCUMENTS), benchmark=([(0, "of zebras")], ITEMS))
    assert [r["content"] for r in rq.recall_results(spark, sf).collect()] == [line]
    got = rq.recall_context_budget(spark, sf).first()
    assert got["injected"] == 1 and got["n_chars"] == len(rq.recall.HEADER) + len("1. [score=1.00] /src0/1.txt [src0]\n   ") + 280


def test_every_turn_is_judged_on_its_own_text(spark, tables):
    text = "what did we decide before about the database of the second site"
    turns = [(c, t, "user", text) for c in range(2) for t in range(5)]
    sf = tables(conversations=(turns, "conv_id long, turn long, role string, text string"))
    assert {r["reason"] for r in rq.recall_decision(spark, sf).collect()} == {"memory_prompt"}
    assert {r["query"] for r in rq.recall_query_rewrite(spark, sf).collect()} == {text}


def test_made_up_turns_reach_the_other_reasons(spark, tables):
    made = ["- what did we  decide before about it", "memory_search (it", "it", "some other words"]
    sf = tables(conversations=([(0, t, "user", text) for t, text in enumerate(made)], "conv_id long, turn long, role string, text string"))
    got = [r["reason"] for r in rq.recall_decision(spark, sf).orderBy("turn").collect()]
    assert got == ["memory_prompt", "explicit_memory_tool_call", "prompt_too_short", "non_memory_prompt"]


def test_long_documents_are_searched_by_chunk_for_whole_items(spark, tables):
    item = "seven quiet rivers cross the old northern plain"
    lines = [f"line {i} of a long report" for i in range(300)]
    lines[280] = item
    long_text, start = "\n".join(lines), "seven quiet hills and nothing more"
    others = [(i, f"filler {i}", "en", "src1", 8) for i in range(3, 9)]
    sf = tables(
        documents=([(1, long_text, "en", "src0", len(long_text)), (2, start, "en", "src0", len(start)), *others], DOCUMENTS),
        benchmark=([(0, item), (90, item)], ITEMS),
        embeddings=([(0, [1.0, 0.0], 0), (5, [1.0, 0.1], 0)], "vec_id long, embedding array<float>, label int"),
    )
    got = [(r["query_id"], r["doc_id"], r["chunk_idx"]) for r in rq.bm25_phrase(spark, sf).orderBy("query_id").collect()]
    assert got == [(0, 1, 2), (90, 1, 2)]  # not document 2, which only starts like the item
    rows = rq.hybrid_search(spark, sf).orderBy("query_id", "rank").collect()
    # the item with a vector finds its neighbour too; the one without stays in the lexical list
    assert [(r["query_id"], r["file"]) for r in rows] == [(0, "/src0/1.txt"), (0, "/src1/5.txt"), (90, "/src0/1.txt")]
    assert 1 < rows[0]["start_line"] <= 281 <= rows[0]["end_line"] == 300


def test_each_expansion_has_a_vector_list(spark):
    rows = [(i, i, t, t, f"/{i}", "c", 1, 1) for i, t in enumerate(["one", "two", "three", "four"])]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, content string, title string, path string, collection string, start_line int, end_line int")
    a = lexical.analyzed(chunks)
    data = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0])], "chunk_id long, embedding array<float>")
    asked = [
        (7, "one", [1.0, 0.0, 0.0], ["one", "b", "d"], [[0.0, 0.0, 1.0], [0.0, 1.0, 0.0], None]),  # the query itself again counts once
        (8, "x", None, ["y"], [[0.0, 0.0, 1.0]]),
    ]
    q = spark.createDataFrame(asked, "query_id long, query string, embedding array<float>, expansions array<string>, expansion_embeddings array<array<float>>")
    corpus = Corpus(chunks, lexical.postings(a), lexical.statistics(a), data)
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in search(q, corpus, Options(mode="vector")).collect()}
    assert got.keys() == {(7, 0), (7, 1), (8, 2)}
    assert math.isclose(got[7, 1], (1 / 61 + 0.05) / (2 / 61 + 0.05))  # weight 1 beside the original's 2
    both = search(q.withColumn("query", F.lit("zz")), corpus, Options()).collect()
    assert {(7, 0), (7, 1), (7, 2), (8, 2)} <= {(r["query_id"], r["chunk_id"]) for r in both}


def test_new_rows_are_numbered_in_ranges(spark):
    keys = sorted((f"c{i % 3}", f"/p{i * 7919 % 1000:04}") for i in range(1000))
    rows = spark.createDataFrame([*keys[::-1], (None, "/x")], "c string, p string")
    got = catalog.numbered(rows, ["c", "p"], "n", 5)
    assert {(r["c"], r["p"]): r["n"] for r in got.collect()} == {k: i for i, k in enumerate([(None, "/x"), *keys], 6)}
    assert "Window [row_number() windowspecdefinition(__range" in got._jdf.queryExecution().optimizedPlan().toString()
    none = catalog.numbered(rows.limit(0), ["c", "p"], "n")
    assert none.count() == 0
