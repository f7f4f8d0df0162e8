"""The index of segments: what a change writes, what a search reads, and that both are as of an index made anew."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.jobs import indexing, migrations, segments
from tessera.operators import lexical
from tessera.sources.files import files, listed

WORDS = [f"w{i}" for i in range(60)]


def listing(spark, rows):
    """rows: path, text, mtime[, error]"""
    made = spark.createDataFrame([("c", f"/{r[0]}", r[1], float(r[2]), r[3] if len(r) > 3 else None) for r in rows], "collection string, path string, content string, mtime double, error string")
    return made.select("collection", "path", F.col("path").alias("title"), "mtime", F.sha1("content").alias("hash"), "content", F.lit(False).alias("markdown"), "error")


def folders(root):
    return {str(p) for p in root.rglob("*.parquet")}


def found(spark, root, asked, **how):
    index = segments.current(spark, root)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, phrases array<array<string>>")
    scored = lexical.bm25(queries, index.inverted(), index.statistics(), digits=6, **how)
    named = index.documents.select("doc_id", "path")
    return scored.withColumn("doc_id", segments.doc_of(F.col("chunk_id"))).join(named, "doc_id")


def results(spark, root, asked, **how):
    return sorted((r["query_id"], r["path"], r["score"]) for r in found(spark, root, asked, **how).collect())


ASKED = [[["w1"]], [["w1", "w2"]], [["w3", "w4", "w5"]], [["w6"], ["w7", "w8"]], [["nothing"]], [["w9"], ["w9", "w9"]]]


def text(r):
    # the first few words in turn, so that phrases occur
    at = r.randrange(40)
    return " ".join(WORDS[(at + k) % 60] if r.random() < 0.8 else r.choice(WORDS[:12]) for k in range(r.randint(3, 60)))


def test_changed_index_is_as_one_made_anew(spark, tmp_path):
    r, root = random.Random(3), str(tmp_path / "changed")
    state = {f"d{i}": (text(r), 1) for i in range(30)}
    for step in range(5):
        indexing.refresh(spark, root, listing(spark, [(p, *v) for p, v in state.items()]), merging=step != 4)
        index = segments.current(spark, root)
        assert index.documents.count() == len(state)
        for p in r.sample(sorted(state), 4):
            kind = r.choice(("change", "touch", "remove"))
            if kind == "remove":
                del state[p]
            else:
                state[p] = (text(r) if kind == "change" else state[p][0], step + 2)
        state[f"new{step}"] = (text(r), 1)
    # segments in the middle become one: what they say of the others, and the others of them, still holds
    before = segments.current(spark, root)
    segments.merged(before, before.segments[1:4])
    assert results(spark, root, ASKED) and len(segments.current(spark, root).segments) == len(before.segments) - 2
    indexing.refresh(spark, root, listing(spark, [(p, *v) for p, v in state.items()]), merging=False)
    index, anew = segments.current(spark, root), str(tmp_path / "anew")
    assert len(index.segments) > 1
    indexing.refresh(spark, anew, listing(spark, [(p, *v) for p, v in state.items()]))
    fresh = segments.current(spark, anew)
    assert index.statistics().first() == fresh.statistics().first()
    assert results(spark, root, ASKED) == results(spark, anew, ASKED) and len(results(spark, root, ASKED)) > 20
    counts = lambda i: sorted((x["term"], x["df"], x["cf"]) for x in i._every(lambda s: i.read(s, "terms")).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0").collect())
    assert counts(index) == counts(fresh)
    assert sorted((x["path"], x["hash"], x["mtime"]) for x in index.documents.collect()) == sorted((x["path"], x["hash"], x["mtime"]) for x in fresh.documents.collect())


def test_a_change_writes_a_small_segment(spark, tmp_path):
    r, root = random.Random(5), tmp_path / "index"
    rows = [(f"d{i}", " ".join(r.choice(WORDS) for _ in range(600)), 1) for i in range(400)]
    indexing.refresh(spark, str(root), listing(spark, rows))
    before = folders(root)
    size = lambda paths: sum(os.path.getsize(p) for p in paths)
    indexing.refresh(spark, str(root), listing(spark, [("d0", "w1 w2", 2), *rows[1:]]))
    # a Parquet file's own frame is counted with it: what grows with the index is not among them
    new = folders(root) - before
    assert before <= folders(root) and size(p for p in new if "/chunks/" in p or "/notes/" in p) < 0.05 * size(before)
    assert indexing.refresh(spark, str(root), listing(spark, [("d0", "w1 w2", 2), *rows[1:]])).collect()[0]["status"] == "skipped"
    assert folders(root) == before | new and segments.current(spark, str(root)).version == 2


def test_a_search_reads_what_it_asks_for(spark, tmp_path):
    r, root = random.Random(6), str(tmp_path)
    rows = [(f"d{i}", " ".join(["w1"] * r.choice((1, 1, 1, 6)) + ["x"] * r.choice((2, 40, 500)) + [f"only{i}"]), 1) for i in range(300)]
    indexing.refresh(spark, root, listing(spark, rows))
    index = segments.current(spark, root)
    wanted = spark.createDataFrame([("only7", 0)], "term string, tier int")
    plan = index.inverted().postings(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and plan.count("FileScan parquet") == 1
    read = [p for p in index.inverted().postings(wanted).inputFiles()]
    assert len(read) >= 1
    whole = results(spark, root, [[["w1"]]])
    best = sorted(whole, key=lambda x: -x[2])[:10]
    few = found(spark, root, [[["w1"]]], limit=10)
    got = [(x["query_id"], x["path"], x["score"]) for x in few.collect()]
    # not all of the term's chunks are read, and all of the best are, with the scores that they have among all
    assert len(got) < len(whole) and set(got) <= set(whole) and {x for x in whole if x[2] >= best[-1][2]} <= set(got)


@pytest.mark.parametrize("seed", range(3))
def test_passing_over_tiers_loses_none_of_the_best(spark, tmp_path, seed):
    r, root = random.Random(seed), str(tmp_path)
    rows = [(f"d{i}", " ".join(r.choice(WORDS[: r.choice((2, 5, 60))]) for _ in range(r.choice((2, 9, 80, 600)))), 1) for i in range(120)]
    indexing.refresh(spark, root, listing(spark, rows))
    asked = [[[w]] for w in WORDS[:20]]
    top = lambda rows: {q: sorted(((-s, p) for i, p, s in rows if i == q))[:7] for q in range(len(asked))}
    assert top(results(spark, root, asked, limit=7)) == top(results(spark, root, asked))


def test_files_that_cannot_be_read_keep_what_is_indexed(spark, tmp_path):
    root = str(tmp_path)
    indexing.refresh(spark, root, listing(spark, [("a", "w1 w2", 1), ("b", "w2 w3", 1)]))
    status = indexing.refresh(spark, root, listing(spark, [("a", None, 2, "unreadable"), ("b", "w2 w3", 1), ("new", None, 1, "unreadable")]))
    assert {r["status"]: r["documents"] for r in status.collect()} == {"error": 2, "skipped": 1}
    assert {p for _, p, _ in results(spark, root, [[["w2"]]])} == {"/a", "/b"}
    # read again later, it is what it is then
    status = indexing.refresh(spark, root, listing(spark, [("a", "w9", 2), ("b", "w2 w3", 1)]))
    assert {r["status"]: r["documents"] for r in status.collect()} == {"changed": 1, "skipped": 1}
    assert [p for _, p, _ in results(spark, root, [[["w9"]]])] == ["/a"]


def test_large_files_of_other_kinds_are_not_opened(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\ntext")
    (tmp_path / "B.TXT").write_text("more")
    (tmp_path / "huge.bin").write_bytes(b"x" * 500)
    (tmp_path / "long.txt").write_text("y" * 300)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        rows = {r["relative"]: (r["content"], r["error"]) for r in files(spark, str(tmp_path), "c").collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert rows == {"a.md": ("# A\ntext", None), "B.TXT": ("more", None), "long.txt": (None, "too long")}
    assert [r["relative"] for r in listed(spark, str(tmp_path), glob="*.md").collect()] == ["a.md"]


def test_two_writers_of_one_version(spark, tmp_path):
    root = str(tmp_path)
    indexing.refresh(spark, root, listing(spark, [("a", "w1", 1)]))
    base = segments.current(spark, root)
    indexing.refresh(spark, root, listing(spark, [("a", "w2", 2)]), base=base)
    with pytest.raises(segments.Conflict):
        indexing.refresh(spark, root, listing(spark, [("a", "w3", 3)]), base=base)
    assert [p for _, p, _ in results(spark, root, [[["w2"]]])] == ["/a"] and results(spark, root, [[["w3"]]]) == []
    # the old version is still what it was
    assert base.documents.first()["mtime"] == 1.0
    # a commit that a writer never ended is passed over, and can be removed with the segments that none names
    (tmp_path / "commits" / "3.json").write_text("")
    assert segments.current(spark, root).version == 2
    with pytest.raises(segments.Conflict):
        indexing.refresh(spark, root, listing(spark, [("a", "w3", 3)]))
    assert segments.repaired(spark, root) == 1 and len(os.listdir(tmp_path / "segments")) == 2
    indexing.refresh(spark, root, listing(spark, [("a", "w3", 3)]))
    assert segments.current(spark, root).version == 3


def test_old_snapshots_are_migrated(spark, tmp_path):
    root = str(tmp_path)
    assert migrations.schema_of(spark, root) is None and migrations.migrated(spark, root) == []
    docs = [(1, "c", "/a", "/a", 1.0, 5), (2, "c", "/b", "/b", 1.0, 5)]
    made = spark.createDataFrame(docs, "doc_id long, collection string, path string, title string, mtime double, indexed_at long")
    texts = spark.createDataFrame([(1, "w1 w2"), (2, "w2 w3")], "doc_id long, content string")
    made = made.join(texts, "doc_id").withColumn("hash", F.sha1("content"))
    made.drop("content").write.parquet(f"{root}/v4/documents")
    old = indexing.indexed_chunks(texts.withColumn("markdown", F.lit(False)), 4)
    old.drop("tokens").withColumn("embedding_content", F.col("content")).write.parquet(f"{root}/v4/chunks")
    spark.createDataFrame([(4, 1, 5)], "version int, schema_version int, created_at long").write.parquet(f"{root}/meta")
    assert migrations.schema_of(spark, root) == 1 and segments.current(spark, root) is None
    # a refresh takes the steps first, and finds the files as they were
    status = indexing.refresh(spark, root, listing(spark, [("a", "w1 w2", 1), ("b", "w4", 2)]))
    assert {r["status"]: r["documents"] for r in status.collect()} == {"skipped": 1, "changed": 1}
    assert migrations.schema_of(spark, root) == 2 and segments.current(spark, root).version == 5
    assert {p for _, p, _ in results(spark, root, [[["w2"]]])} == {"/a"} and {p for _, p, _ in results(spark, root, [[["w4"]]])} == {"/b"}
    assert migrations.migrated(spark, root) == []
