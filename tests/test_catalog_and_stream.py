import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import catalog, recall
from tessera.sources import benchmarks, files
from tessera.streaming.watch import applied, debounced, latest_state, owner


def test_ignore_rules(spark):
    rows = spark.createDataFrame([("a.tmp",), ("node_modules/x.md",), ("a/node_modules/x.md",), ("a/node_modules",), ("n.md",)], "p string")
    got = [r[0] for r in rows.select(catalog.ignored(F.col("p"), ["*.tmp", "node_modules"])).collect()]
    assert got == [True, True, True, False, False]


def test_change_statuses(spark):
    schema = "path string, mtime double, hash string"
    now = spark.createDataFrame([("a", 1.0, "h"), ("b", 2.0, "h"), ("c", 2.0, "n"), ("e", 1.0, "h")], schema)
    before = spark.createDataFrame([("a", 1.0, "x"), ("b", 1.0, "h"), ("c", 1.0, "h"), ("d", 1.0, "h")], schema)
    got = {r["path"]: r["status"] for r in catalog.change_status(now, before, "path").collect()}
    assert got == {"a": "skipped", "b": "mtime_only", "c": "changed", "d": "removed", "e": "added"}


def test_upsert_keeps_ids(spark):
    stored = spark.createDataFrame([("a", 5, 1, 0), ("b", 6, 1, 0)], "path string, id long, size int, born int")
    changes = spark.createDataFrame([("b", 9, 7), ("c", 9, 7), ("d", 3, 7)], "path string, size int, born int")
    got = sorted(map(tuple, catalog.upserted(stored, changes, ["path"], "id", ["born"]).collect()))
    assert got == [("a", 5, 1, 0), ("b", 6, 9, 0), ("c", 7, 9, 7), ("d", 8, 3, 7)]


def test_cascade_and_status(spark):
    docs = spark.createDataFrame([(1, "x", 5), (2, "x", 9), (3, "y", 1)], "doc_id long, collection string, indexed_at long")
    chunks = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "doc_id long, content string")
    names = spark.createDataFrame([("x",), ("y",), ("z",)], "name string")
    assert sorted(map(tuple, catalog.collection_status(names, docs, chunks).collect())) == [("x", 2, 2, 9), ("y", 1, 1, 1), ("z", 0, 0, None)]
    left = catalog.cascade_deleted({"documents": docs, "chunks": chunks}, docs.where("doc_id = 1"))
    assert left["documents"].count() == 2 and left["chunks"].count() == 1


def test_cache(spark):
    rows = spark.createDataFrame([("k", "old", 10, 50), ("k", "new", 20, 50), ("l", "x", 0, 50)], "cache_key string, response string, created_at long, ttl_sec int")
    live = catalog.latest(rows).where(catalog.alive(F.lit(60))).collect()
    assert [(r["cache_key"], r["response"]) for r in live] == [("k", "new")]


def test_files(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, text in (("root.md", "# Root\nx"), ("nested/child.TXT", "plain"), ("image.png", "no"), ("node_modules/a.md", "no")):
        (tmp_path / name).write_text(text)
    rows = files.files(spark, str(tmp_path), "c").collect()
    assert sorted((r["relative"], r["title"], r["markdown"]) for r in rows) == [("nested/child.TXT", "child", False), ("root.md", "Root", True)]


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\n\nq2\td2\t0\n")
    (tmp_path / "q.trec").write_text("q1 0 d1 1\n")
    (tmp_path / "c.jsonl").write_text('{"_id": "1", "title": " T ", "text": "x"}\n{"_id": "2", "title": "", "text": "y"}\n')
    assert sorted(map(tuple, benchmarks.judgements(spark, str(tmp_path / "q.tsv")).collect())) == [("q1", "d1", 2), ("q2", "d2", 0)]
    assert benchmarks.judgements(spark, str(tmp_path / "q.trec")).first()["doc_id"] == "d1"
    assert sorted(map(tuple, benchmarks.corpus(spark, str(tmp_path / "c.jsonl")).collect())) == [("1", "T\n\nx\n"), ("2", "y\n")]
    run = spark.createDataFrame([("q1", "d1", 1, 0.5)], "query_id string, doc_id string, rank int, score double")
    benchmarks.run_lines(run, "me").write.text(str(tmp_path / "run"))
    assert benchmarks.read_run(spark, str(tmp_path / "run")).first().asDict() == {"query_id": "q1", "doc_id": "d1", "rank": 1, "score": 0.5, "name": "me"}


EVENTS = [("a", "add", 0), ("a", "change", 300), ("a", "change", 2000), ("b", "add", 100), ("b", "unlink", 400)]


def event_rows(spark):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([(p, op, start + dt.timedelta(milliseconds=ms)) for p, op, ms in EVENTS], "path string, op string, ts timestamp")


def test_bursts(spark):
    rows = sorted((r["path"], r["op"], r["changes"]) for r in debounced(event_rows(spark)).collect())
    assert rows == [("a", "change", 1), ("a", "change", 2), ("b", "unlink", 2)]


def test_stream_equals_batch(spark, tmp_path):
    batch = latest_state(debounced(event_rows(spark))).orderBy("path").collect()
    for i, row in enumerate(event_rows(spark).collect()):
        spark.createDataFrame([row], "path string, op string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del i
    far = event_rows(spark).limit(1).select(F.lit("z").alias("path"), F.lit("add").alias("op"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    far.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, op string, ts timestamp").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = debounced(stream, late="1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    got = latest_state(spark.read.parquet(out)).where("path <> 'z'").orderBy("path").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in batch]


def test_applying_twice_changes_nothing(spark):
    stored = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "path string, content string")
    changes = spark.createDataFrame([("a", "change"), ("b", "unlink"), ("d", "add")], "path string, op string")
    read = lambda paths: paths.withColumn("content", F.lit("new"))
    once = applied(stored, changes, read)
    assert sorted(map(tuple, once.collect())) == [("a", "new"), ("c", "old"), ("d", "new")] == sorted(map(tuple, applied(once, changes, read).collect()))


def test_owner_is_a_whole_folder(spark):
    rows = spark.createDataFrame([("/a/doc/x",), ("/a/docs/x",), ("/b/x",)], "p string")
    got = [r[0] for r in rows.select(owner(F.col("p"), [("one", "/a/doc"), ("two", "/a/docs/")])).collect()]
    assert got == ["one", "two", None]


def test_recall(spark):
    rows = [("what did we decide before about PostgreSQL", "user"), ("hi", "user"), ('memory_search("x")', "user"), ("postgresql choice", "user"), ("remember this", "cron")]
    d = spark.createDataFrame(rows, "p string, t string").select(recall.decision(F.col("p"), F.col("t")).alias("r"), recall.query_for(F.col("p")).alias("q")).collect()
    assert [r["r"] for r in d] == ["memory_prompt", "prompt_too_short", "explicit_memory_tool_call", "non_memory_prompt", "non_user_trigger"]
    assert [r["q"] for r in d][1] == "previously recorded hi" and [r["q"] for r in d][0] == rows[0][0]
    more = spark.createDataFrame([("我们 记得 什么",), ("数据库 连接",)], "p string").select(recall.query_for(F.col("p")).alias("q")).collect()
    assert [r["q"] for r in more] == ["我们 记得 什么", "之前记录的 数据库 连接"]
    found = spark.createDataFrame([(0, "/a", 0.93, 1, "c", "t", "x  y"), (0, "/a", 0.95, 2, "c", "t", "z"), (0, "/b", 0.1, 3, "c", None, "z")], "query_id long, path string, score double, rank int, collection string, title string, content string")
    best = recall.selected(found)
    assert [(r["path"], r["score"]) for r in best.collect()] == [("/a", 0.95)]
    assert recall.context(best, 600).first()["injected"] == 1 and recall.context(best, 80).count() == 0
