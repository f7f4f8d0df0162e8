import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import phrases_of
from tessera.operators import evaluation, fusion, lexical
from tessera.operators.nearest import neighbours
from tessera.operators.search import Corpus, Options, search

TEXTS = ["machine learning algorithms", "vector database embeddings", "learning a vector of learning machine", "deep machine learning for a database", ""]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, i, t, f"t{i}", f"/col/{i}.md", "col-a" if i % 2 == 0 else "col-b", 1, 1) for i, t in enumerate(TEXTS)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, content string, title string, path string, collection string, start_line int, end_line int")
    a = lexical.analyzed(chunks)
    vectors = spark.createDataFrame([(i, [1.0 - 0.2 * i, 0.3 * i]) for i in range(5)], "chunk_id long, embedding array<float>")
    return Corpus(chunks, lexical.postings(a), lexical.statistics(a), vectors)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_bm25_equals_fts5(spark, corpus):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(content, tokenize=\"unicode61 remove_diacritics 1\")")
    con.executemany("INSERT INTO f(rowid, content) VALUES (?, ?)", list(enumerate(TEXTS)))
    for text in ("machine learning", "learning", "database", "nothing"):
        want = {r: -s for r, s in con.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (f'"{text}"',))}
        q = asked(spark, text).select("query_id", phrases_of(F.col("query")).alias("phrases"))
        got = {r["chunk_id"]: r["score"] for r in lexical.bm25(q, corpus.index, corpus.stats).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_overlapping_phrase_counts(spark):
    chunks = spark.createDataFrame([(1, "aa aa aa"), (2, "bb")], "chunk_id long, content string")
    q = asked(spark, "aa aa").select("query_id", phrases_of(F.col("query")).alias("phrases"))
    assert lexical.phrase_hits(q, lexical.postings(lexical.analyzed(chunks))).first()["tf"] == 2


def test_collection_filter_keeps_statistics(spark, corpus):
    rows = search(asked(spark, "learning"), corpus, Options(mode="bm25", collections=("col-a",))).collect()
    assert {r["collection"] for r in rows} == {"col-a"}


def test_hybrid_limit_and_order(spark, corpus):
    q = asked(spark, "machine learning", "zzz").withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    rows = search(q, corpus, Options(limit=2)).orderBy("query_id", "rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 1, 2] and rows[0]["score"] == 1.0 and rows[0]["docid"] == "000000"


def test_expansions_add_lists(spark, corpus):
    q = asked(spark, "machine learning").withColumn("expansions", F.array(F.lit("machine learning"), F.lit("database")))
    found = {r["chunk_id"] for r in search(q, corpus, Options()).collect()}
    assert {0, 1, 3} <= found


def test_both_kinds_of_index_agree(spark):
    import random

    r = random.Random(2)
    texts = [" ".join(r.choice(("aa", "bb", "cc", "dd", "ee")) for _ in range(r.randint(0, 12))) for _ in range(60)]
    a = lexical.analyzed(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string"))
    phrases = [[r.choice(("aa", "bb", "cc", "zz")) for _ in range(r.randint(1, 4))] for _ in range(20)]
    q = spark.createDataFrame([(i, [p, phrases[i - 1]]) for i, p in enumerate(phrases)], "query_id long, phrases array<array<string>>")
    want = {}
    for i, p in enumerate(phrases):
        for k, phrase in enumerate((p, phrases[i - 1])):
            for c, t in enumerate(texts):
                w = t.split()
                n = sum(w[j : j + len(phrase)] == phrase for j in range(len(w) - len(phrase) + 1))
                if n:
                    want[i, k, c] = (n, len(w))
    for index in (a, lexical.postings(a)):
        got = {(x["query_id"], x["phrase_id"], x["chunk_id"]): (x["tf"], x["dl"]) for x in lexical.phrase_hits(q, index).collect()}
        assert got == want
    single = q.select("query_id", F.transform("phrases", lambda p: F.slice(p, 1, 1)).alias("phrases"))
    one, two = ({tuple(x) for x in lexical.phrase_hits(single, index).select("query_id", "phrase_id", "chunk_id", "tf").collect()} for index in (a, lexical.postings(a)))
    assert one == two and one


def test_tokens_that_no_query_has_are_not_shuffled(spark, corpus):
    """The scan's tokens meet the broadcast terms before any exchange."""
    chunks = spark.range(50).repartition(3).selectExpr("id AS chunk_id", "concat('common words and term', id % 7) AS content")
    q = asked(spark, "term3").select("query_id", phrases_of(F.col("query")).alias("phrases"))
    plan = lexical.phrase_hits(q, lexical.analyzed(chunks))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("BroadcastHashJoin") > plan.index("Exchange hashpartitioning(query_id") and plan.count("Exchange hashpartitioning") == 1


def test_han_text_is_found_by_its_segments(spark):
    from tessera.functions.han import bigrams, dictionary

    chunks = spark.createDataFrame([(1, "我们使用向量数据库 vector database"), (2, "关系数据库连接"), (3, "天气很好"), (4, "plain words")], "chunk_id long, content string")
    for segmenter in (bigrams, dictionary(["数据库", "向量", "连接", "我们", "使用", "关系", "天气"])):
        a = lexical.analyzed(chunks, segmenter=segmenter)
        find = lambda text: [r["chunk_id"] for r in lexical.bm25(asked(spark, text).select("query_id", Options(segmenter=segmenter).phrases(F.col("query")).alias("phrases")), a, lexical.statistics(a)).orderBy(F.desc("score")).collect()]  # noqa: E731, B023
        assert set(find("数据库连接")) == {1, 2} and find("数据库连接")[0] == 2
        assert find("向量") == [1] and find("plain words") == [4] and find("vector") == [1]


def test_segments():
    from tessera.functions.han import segments

    words = frozenset(["数据库", "连接"])
    assert segments("数据库连接", words, 3) == ["数据库", "连接"] and segments("search引擎", words, 3) == ["search", "引擎"]
    assert segments("新数据库很快速", words, 3) == ["新", "数据库", "很快", "快速"] and segments(" a b ", words, 3) == ["a", "b"]


def test_marked_snippets_fold_as_the_index_does(spark):
    from tessera.functions.responses import highlight

    assert highlight("Un Été à Paris", [["ete"]]) == "Un **Été** à Paris"
    rows = [(1, 1, "Le café est bon", "t", "/a", "c", 3, 3)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, content string, title string, path string, collection string, start_line int, end_line int")
    a = lexical.analyzed(chunks)
    corpus = Corpus(chunks, a, lexical.statistics(a))
    assert search(asked(spark, "cafe"), corpus, Options(mode="bm25")).first()["snippet"] == "Le **café** est bon"


def test_vectors_of_another_width_are_an_error(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "id long, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        neighbours(v.where("id = 1"), v.where("id = 2"), 1).collect()


def test_many_query_blocks_meet_by_keys(spark, monkeypatch):
    from tessera.operators import nearest

    r = spark.range(40).selectExpr("id", "array(cast(cos(id) as float), cast(sin(id) as float)) AS embedding")
    want = [tuple(x) for x in neighbours(r, r, 3).orderBy("query_id", "rank").collect()]
    assert [tuple(x) for x in neighbours(r, r, 3, block=7).orderBy("query_id", "rank").collect()] == want
    monkeypatch.setattr(nearest, "MOST_BROADCAST", 5)
    dealt = neighbours(r, r, 3, block=7)
    assert [tuple(x) for x in dealt.orderBy("query_id", "rank").collect()] == want
    assert "BroadcastNestedLoop" not in dealt._jdf.queryExecution().executedPlan().toString()


def listed(spark, rows):
    return spark.createDataFrame([(0, c, s) for c, s in rows], "query_id long, chunk_id long, score double")


def test_single_list_keeps_scores(spark):
    one = fusion.ordered(fusion.fused([fusion.RankedList(listed(spark, [(1, 0.9), (2, 0.45)]))]), 10)
    assert [(r["chunk_id"], r["score"]) for r in fusion.finished(one, 10).orderBy("rank").collect()] == [(1, 1.0), (2, 0.5)]


def test_empty_lexical_list_counts(spark):
    lists = [fusion.RankedList(listed(spark, []), counts_when_empty=True), fusion.RankedList(listed(spark, [(1, 0.9), (2, 0.45)]))]
    got = {r["chunk_id"]: r["score"] for r in fusion.fused(lists).collect()}
    assert math.isclose(got[1], 2 / 61 + 0.05) and math.isclose(got[2], 2 / 62 + 0.02)


def test_weights_and_ties(spark):
    lists = [fusion.RankedList(listed(spark, [(1, 1.0), (3, 0.5)]), 2.0), fusion.RankedList(listed(spark, [(2, 1.0), (3, 0.5)]), 1.0)]
    assert [r["chunk_id"] for r in fusion.ordered(fusion.fused(lists), 10).orderBy("rank").collect()] == [1, 3, 2]
    even = [fusion.RankedList(listed(spark, [(9, 1.0)])), fusion.RankedList(listed(spark, [(2, 1.0)]))]
    assert [r["chunk_id"] for r in fusion.ordered(fusion.fused(even), 10).orderBy("rank").collect()] == [9, 2]


def test_blend_drops_what_the_reranker_leaves_out(spark):
    ranked = spark.createDataFrame([(0, 1, 0.2, 1), (0, 2, 0.1, 2), (0, 3, 0.05, 3)], "query_id long, chunk_id long, score double, rank int")
    scores = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.9)], "query_id long, chunk_id long, rerank double")
    got = {r["chunk_id"]: r["score"] for r in fusion.blended(ranked, scores).collect()}
    assert got.keys() == {1, 2} and math.isclose(got[1], 0.75 + 0.25 / 9) and math.isclose(got[2], 0.375 + 0.25)
    assert fusion.blended(ranked, scores.limit(0)).count() == 3


def test_weak_results_go_without_refill(spark):
    ranked = listed(spark, [(1, 0.9), (2, 0.45), (3, 0.005)]).withColumn("rank", F.col("chunk_id").cast("int"))
    assert fusion.finished(ranked, 10, 0.01).count() == 2 and fusion.finished(ranked, 10).count() == 3


def test_neighbours(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (6, None)], "id long, embedding array<float>")
    got = [(r["chunk_id"], r["score"]) for r in neighbours(v.where("id = 2"), v, 4, block=2).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 1.0), (3, 0.0), (4, 0.0)]
    assert neighbours(v.where("id = 2"), v, 9, 0.3).count() == 2


def test_metrics(spark):
    qrels = spark.createDataFrame([("q1", "d1", 2), ("q1", "d2", 0), ("q2", "d3", 1), ("q3", "d9", 0)], "query_id string, doc_id string, relevance int")
    run = spark.createDataFrame([("q1", "d1", 1, 1.0), ("q2", "x", 1, 1.0), ("q2", "d3", 2, 0.5)], "query_id string, doc_id string, rank int, score double")
    m = {r["query_id"]: r for r in evaluation.per_query(run, qrels, 10).collect()}
    assert m["q1"]["ndcg"] == 1 and math.isclose(m["q2"]["ndcg"], 1 / math.log2(3)) and m["q2"]["mrr"] == 0.5 and m["q2"]["precision"] == 0.5
    assert m["q3"]["recall"] == 0 and m["q3"]["hit"] == 0
    metrics = evaluation.per_query(run, qrels, 10)
    assert evaluation.averaged(metrics, True).first()["queries"] == 2 and evaluation.averaged(metrics, False).first()["queries"] == 3


def test_best_chunk_stands_for_its_document(spark):
    hits = spark.createDataFrame([(0, 11, 1, 0.5, 2), (0, 12, 1, 0.9, 1), (0, 21, 2, 0.9, 3)], "query_id long, chunk_id long, doc_id long, score double, chunk_rank int")
    rows = evaluation.best_chunks(hits).orderBy("rank").collect()
    assert [(r["doc_id"], r["chunk_id"]) for r in rows] == [(1, 12), (2, 21)]
