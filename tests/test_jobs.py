import os

from pyspark.sql import functions as F

from tessera.functions.responses import expansions, highlight, highlighted, reranked
from tessera.jobs import indexing
from tessera.operators.search import Options, search
from tessera.sources.files import files


def write(root, **texts):
    for name, text in texts.items():
        (root / f"{name}.md").write_text(text)


def test_index_follows_its_files(spark, tmp_path):
    root, index = tmp_path / "notes", str(tmp_path / "index")
    root.mkdir()
    write(root, a="# Alpha\nmachine learning", b="# Beta\nvector database", c="# Gamma\nnothing much")
    read = lambda: files(spark, str(root), "notes")
    assert indexing.current(spark, index) is None and indexing.status(None) == {"documents": 0, "chunks": 0}
    assert {r["status"]: r["documents"] for r in indexing.refresh(spark, index, read()).collect()} == {"added": 3}
    ids = {r["title"]: r["doc_id"] for r in indexing.current(spark, index).tables["documents"].collect()}
    assert sorted(ids.values()) == [1, 2, 3]

    os.remove(root / "c.md")
    write(root, b="# Beta\nmachine learning too", d="# Delta\nnew")
    os.utime(root / "a.md", (1, 1))
    got = {r["status"]: r["documents"] for r in indexing.refresh(spark, index, read()).collect()}
    assert got == {"mtime_only": 1, "changed": 1, "removed": 1, "added": 1}
    now = indexing.current(spark, index)
    assert now.version == 2 and indexing.status(now) == {"documents": 3, "chunks": 3}
    after = {r["title"]: r["doc_id"] for r in now.tables["documents"].collect()}
    assert after["Alpha"] == ids["Alpha"] and after["Beta"] == ids["Beta"] and after["Delta"] not in (ids["Alpha"], ids["Beta"])
    q = spark.createDataFrame([(0, "machine learning"), (1, "vector database")], "query_id long, query string")
    found = search(q, now.corpus(), Options(mode="bm25")).orderBy("query_id", "rank").collect()
    assert {r["title"] for r in found} == {"Alpha", "Beta"} and {r["query_id"] for r in found} == {0}
    assert indexing.refresh(spark, index, read()).collect()[0]["status"] == "skipped"
    lines = [r["value"] for r in indexing.formatted(search(q, now.corpus(), Options(mode="bm25"))).collect()]
    assert all("(" in x and "#" in x for x in lines)


def test_stream_refreshes_the_index(spark, tmp_path):
    root, index, events = tmp_path / "notes", str(tmp_path / "index"), str(tmp_path / "events")
    root.mkdir()
    write(root, a="# Alpha\nmachine learning")
    spark.createDataFrame([("a.md", "add")], "path string, op string").coalesce(1).write.parquet(events)
    stream = spark.readStream.schema("path string, op string").parquet(events)
    q = stream.writeStream.foreachBatch(indexing.refreshing(index, lambda s: files(s, str(root), "notes"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert indexing.status(indexing.current(spark, index)) == {"documents": 1, "chunks": 1}


def test_answers_of_models(spark):
    cases = {
        '["a", " b ", "", null, 3]': ["a", "b"],
        '```json\n["x"]\n```': ["x"],
        '{"note": "n", "queries": ["q1"], "items": ["no"]}': ["q1"],
        '{"odd": ["o"]}': ["o"],
        'Here you are: ["p", "q"] and more': ["p", "q"],
        "[]": None,
        "nothing": None,
        "{}": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", expansions(F.col("raw")).alias("v")).collect()
    assert {r["raw"]: r["v"] for r in rows} == cases


def test_answers_of_rerankers(spark):
    schema = "results array<struct<index:int,relevance_score:double,score:double,document:string>>, docs array<string>"
    rows = [
        ([(1, 0.9, None, None), (0, 0.1, None, None), (7, 1.0, None, None)], ["a", "b"]),
        ([(None, None, 0.4, "b"), (None, None, None, "a")], ["a", "b"]),
        ([(None, 0.4, None, "zz")], ["a", "b"]),
        ([], ["a"]),
    ]
    got = [r["v"] and [tuple(x) for x in r["v"]] for r in spark.createDataFrame(rows, schema).select(reranked(F.col("results"), F.col("docs")).alias("v")).collect()]
    assert got == [[(1, 0.9), (0, 0.1)], [(1, 0.4), (0, 0.0)], None, []]


def test_highlights(spark):
    text = " ".join(f"w{i}" for i in range(50)) + " red fox."
    assert highlight(text, [["red", "fox"]]).endswith("w49 **red fox**.") and highlight(text, [["red", "fox"]]).startswith("…")
    assert highlight(text, [["none"]]) is None and highlight(None, [["a"]]) is None
    row = spark.createDataFrame([("A red fox", [["red"]])], "c string, p array<array<string>>").select(highlighted("c", "p").alias("h")).first()
    assert row["h"] == "A **red** fox"


def test_materialized_passages(spark, tmp_path):
    rows = spark.createDataFrame([("d#1", "x"), ("d#2", "y")], "id string, content string")
    indexing.materialized(rows, "id", str(tmp_path / "out"))
    assert {f"{p.parent.name}/{p.name}": p.read_text() for p in (tmp_path / "out").rglob("*.txt")} == {"ZC/ZCMx.txt": "x", "ZC/ZCMy.txt": "y"}
