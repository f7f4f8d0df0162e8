"""Providers, vectors in the index, and the clocked sync of collections."""

import dataclasses
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import providers
from tessera.jobs import indexing
from tessera.operators import provided
from tessera.operators.search import Options, search, warned
from tessera.sources.files import files
from tessera.streaming.watch import clocked


def test_a_failing_batch_costs_its_own_rows(spark):
    rows = spark.createDataFrame([(i, "bad" if i == 5 else f"text {i}") for i in range(10)] + [(10, None), (11, "")], "id long, text string").coalesce(1)
    got = {r["id"]: r for r in providers.embedded(rows, providers.LetterProvider(fails_on="bad"), limits=providers.Limits(batch=4)).collect()}
    assert [i for i in range(12) if got[i]["embedding"] is None] == [4, 5, 6, 7, 10, 11]
    assert got[4]["failed"].startswith("TimeoutError") and got[10]["failed"] is None
    assert abs(sum(x * x for x in got[0]["embedding"]) - 1) < 1e-6


def test_reranking_fails_open_by_query(spark):
    rows = spark.createDataFrame(
        [(1, "cat", 7, "a cat", 1), (1, "cat", 8, "dogs only", 2), (2, "boom", 7, "a cat", 1)], "query_id long, query string, chunk_id long, content string, rank int"
    )
    got = {(r["query_id"], r["chunk_id"]): r["rerank"] for r in providers.reranked(rows, providers.LetterProvider(fails_on="boom")).collect()}
    assert got.keys() == {(1, 7), (1, 8)} and got[1, 7] > got[1, 8] == 0


def texts(spark, rows):
    made = spark.createDataFrame([("c", f"/{p}", t, float(m)) for p, t, m in rows], "collection string, path string, content string, mtime double")
    return made.select("collection", "path", F.col("path").alias("title"), "mtime", F.sha1("content").alias("hash"), "content", F.lit(False).alias("markdown"))


def test_vectors_follow_their_chunks(spark, tmp_path):
    root, provider = str(tmp_path), providers.LetterProvider()
    assert indexing.vectors(spark, root) is None
    indexing.refresh(spark, root, texts(spark, [("a", "eta one", 1), ("b", "son two", 1), ("gone", "rain", 1)]))
    assert indexing.embed_missing(spark, root, provider, "letters").first().asDict() == {"embedded": 3, "failed": 0}
    before = {r["chunk_id"]: r["embedding"] for r in indexing.vectors(spark, root).collect()}
    index = indexing.current(spark, root)
    assert indexing.status(index, indexing.vectors(spark, root)) == {"documents": 3, "chunks": 3, "embedded": 3}
    # another dimension is refused, within the rows and against what is stored
    for bad in ([0.5] * 3, [0.5] * 9):
        with pytest.raises(ValueError, match="dimensions"):
            indexing.put_vectors(spark, root, spark.createDataFrame([(next(iter(before)), bad)], "chunk_id long, embedding array<float>"))
    # changed and removed documents lose theirs; what is missing alone is asked for
    indexing.refresh(spark, root, texts(spark, [("a", "eta one", 1), ("b", "son three", 2)]))
    left = {r["chunk_id"] for r in indexing.vectors(spark, root).collect()}
    assert len(left) == 1 and left < before.keys()
    assert indexing.embed_missing(spark, root, provider, "letters").first()["embedded"] == 1
    assert indexing.vectors(spark, root).count() == 2
    asked = spark.createDataFrame([(1, "eta")], "query_id long, query string").withColumn("embedding", F.lit([1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]).cast("array<float>"))
    found = search(asked, indexing.current(spark, root).corpus(indexing.vectors(spark, root)), Options(mode="hybrid")).orderBy("rank").collect()
    assert found[0]["file"] == "/a" and {r["file"] for r in found} == {"/a", "/b"}
    indexing.reset_vectors(spark, root)
    assert indexing.vectors(spark, root) is None
    indexing.put_vectors(spark, root, spark.createDataFrame([(next(iter(left)), [1.0, 0.0])], "chunk_id long, embedding array<float>"))
    assert indexing.vectors(spark, root).count() == 1


def test_collections_are_synced_by_the_clock(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.txt").write_text(f"text of {name}")
    (tmp_path / "one" / "image.png").write_text("x")
    root, registered, seen = str(tmp_path / "index"), [["one"], ["one", "two"], ["two"]], []
    rows = lambda names: spark.createDataFrame([(n, f"{tmp_path}/{n}") for n in names], "name string, path string")

    def look(session):
        if not registered:
            return
        names = registered.pop(0)
        watched = seen[-1][0] if seen else []
        events, counts = indexing.synced(session, root, rows(names), rows(watched), lambda name, path: files(session, path, name))
        seen.append((names, sorted(tuple(r) for r in events.collect()), {r["status"]: r["documents"] for r in counts.collect()}))

    query = clocked(spark, look, str(tmp_path / "checkpoint"), "1 second")
    for _ in range(120):
        if not registered and len(seen) == 3 or query.exception():
            break
        query.awaitTermination(1)
    query.stop()
    assert query.exception() is None
    assert [s[1] for s in seen] == [[("one", "collection_added")], [("two", "collection_added")], [("one", "collection_removed")]]
    assert [s[2] for s in seen] == [{"added": 1}, {"skipped": 1, "added": 1}, {"removed": 1, "skipped": 1}]
    assert [r["collection"] for r in indexing.current(spark, root).tables["documents"].collect()] == ["two"]


def test_passages_that_are_there_stay(spark, tmp_path):
    path = str(tmp_path / "passages")
    rows = spark.createDataFrame([(f"doc#{i}", f"text {i}") for i in range(6)], "id string, content string")
    assert indexing.materialized(rows, "id", path, most=4) == {"processed": 4, "written": 4, "reused": 0}
    assert indexing.materialized(rows, "id", path) == {"processed": 6, "written": 2, "reused": 4}
    assert sorted(p.read_text() for p in (tmp_path / "passages").rglob("*.txt")) == [f"text {i}" for i in range(6)]


def test_a_call_that_hangs_costs_its_batch(spark):
    class Slow(providers.LetterProvider):
        """Hangs where it is asked for a text with ``hang`` in it."""

        def embed(self, texts):
            if any("hang" in t for t in texts):
                time.sleep(60)
            return providers.LetterProvider.embed(self, texts)

    rows = spark.createDataFrame([(i, "hang" if i == 5 else f"text {i}") for i in range(12)], "id long, text string").coalesce(1)
    limits = providers.Limits(deadline=2.0, in_flight=3, batch=4)
    began = time.monotonic()
    got = {r["id"]: r for r in providers.embedded(rows, Slow(), limits=limits).collect()}
    assert time.monotonic() - began < 30
    assert [i for i in range(12) if got[i]["embedding"] is None] == [4, 5, 6, 7] and got[5]["failed"].startswith("TimeoutError")


def test_calls_end_after_failures_in_a_row():
    made, most, now = [], [0], [0]

    def call(i, fails):
        def run():
            now[0] += 1
            most[0] = max(most[0], now[0])
            made.append(i)
            time.sleep(0.01)
            now[0] -= 1
            if fails:
                raise ValueError("no")
            return i

        return run

    limits = providers.Limits(in_flight=2, give_up_after=3)
    answers = list(providers.called([call(i, i >= 5) for i in range(40)], limits))
    assert [a for a, _ in answers[:5]] == [0, 1, 2, 3, 4] and all(e for _, e in answers[5:]) and len(answers) == 40
    assert len(made) < 12 and answers[-1][1].startswith("not called") and most[0] <= 2
    # a success between failures begins the count anew
    assert not [e for _, e in providers.called([call(i, i % 3 == 0) for i in range(30)], limits) if e and e.startswith("not")]


def test_search_does_without_what_the_provider_cannot_give(spark, tmp_path):
    root = str(tmp_path)
    indexing.refresh(spark, root, texts(spark, [("a", "eta one two three", 1), ("b", "son two", 1), ("c", "rain on stone", 1)]))
    corpus = indexing.current(spark, root).corpus()
    corpus = dataclasses.replace(corpus, embeddings=provided.embedded_chunks(corpus, providers.LetterProvider()))
    queries = spark.createDataFrame([(1, "one two"), (2, "boom two")], "query_id long, query string")
    rows = {r["query_id"]: r for r in provided.completed_queries(queries, providers.LetterProvider(fails_on="boom"), limits=providers.Limits(batch=1)).collect()}
    assert rows[1]["expansions"] == ["one", "two"] and rows[2]["expansions"] == [] and rows[2]["hyde"] is None and rows[1]["hyde"] is not None
    assert len(rows[1]["expansion_embeddings"]) == 2 and None not in rows[1]["expansion_embeddings"] and rows[2]["embedding"] is None
    found = provided.provided_search(queries, corpus, providers.LetterProvider(fails_on="boom"), limits=providers.Limits(batch=1)).collect()
    assert {r["query_id"] for r in found} == {1} and next(r["file"] for r in found if r["rank"] == 1) == "/a"
    # lexical search alone asks for no expansion and no vector
    assert provided.completed_queries(queries, providers.LetterProvider(), mode="bm25").columns == ["query_id", "query"]


def test_a_list_that_fails_costs_itself_alone(spark, tmp_path):
    root = str(tmp_path)
    indexing.refresh(spark, root, texts(spark, [("a", "eta one", 1), ("b", "son two", 1)]))
    corpus = indexing.current(spark, root).corpus()
    broken = dataclasses.replace(corpus, embeddings=spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "chunk_id long, embedding array<float>"))
    asked = spark.createDataFrame([(1, "one", [1.0, 0.0, 0.0])], "query_id long, query string, embedding array<float>")
    warnings = []
    assert [r["file"] for r in search(asked, broken, warnings=warnings).collect()] == ["/a"] and len(warnings) == 1 and warnings[0].startswith("vector search failed")
    assert [tuple(r) for r in warned(asked, warnings).collect()] == [(1, warnings[0])]
    nothing = dataclasses.replace(broken, index=None)
    assert search(asked, nothing, warnings=(all_ := [])).collect() == [] and len(all_) == 2
