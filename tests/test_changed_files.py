"""Changed files as a stream, and passages as files."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.sources import passages
from tessera.streaming.changes import ChangedFilesReader, changed_files, passed_over


def taken(spark, root, work, **options):
    """The events of one run, as (path below the root, op), batch by batch."""
    seen = []
    stream = changed_files(spark, str(root), str(work / "state"), **({"settle": 0} | options))
    sink = lambda rows, batch: seen.extend((os.path.relpath(r["path"], root), r["op"]) for r in rows.collect())
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(work / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return sorted(seen)


def test_a_restarted_stream_neither_loses_nor_repeats(spark, tmp_path):
    root, work = tmp_path / "notes", tmp_path / "work"
    (root / "sub").mkdir(parents=True)
    (root / ".hidden").mkdir()
    work.mkdir()
    for name in ("a.md", "sub/b.txt", "c.md", "image.png", ".hidden/x.md", ".dot.md", "sub/draft.md"):
        (root / name).write_text("one")
    ignore = {"ignore": "sub/draft.md,*.tmp"}
    assert taken(spark, root, work, **ignore) == [("a.md", "add"), ("c.md", "add"), ("sub/b.txt", "add")]
    assert taken(spark, root, work, **ignore) == []
    (root / "a.md").write_text("another")
    os.remove(root / "c.md")
    (root / "d.markdown").write_text("new")
    assert taken(spark, root, work, **ignore) == [("a.md", "change"), ("c.md", "unlink"), ("d.markdown", "add")]
    os.utime(root / "d.markdown", (1, 1))
    assert taken(spark, root, work, **ignore) == [("d.markdown", "change")]
    # listings that are needed no more are gone
    assert len([p for p in os.listdir(work / "state") if p.endswith(".whole")]) <= 2


def test_a_batch_that_failed_comes_again(spark, tmp_path):
    root, work = tmp_path / "notes", tmp_path / "work"
    root.mkdir()
    (root / "a.md").write_text("x")
    stream = changed_files(spark, str(root), str(work / "state"), settle=0)

    def broken(rows, batch):
        raise RuntimeError("the sink is away")

    query = stream.writeStream.foreachBatch(broken).option("checkpointLocation", str(work / "checkpoint")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="away"):
        query.awaitTermination(120)
    (root / "b.md").write_text("y")
    # the batch that failed is made again as it was planned; what came after it is the next one
    assert taken(spark, root, work) == [("a.md", "add")] and taken(spark, root, work) == [("b.md", "add")]


def test_files_settle_before_they_come(tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    options = {"root": str(root), "state": str(tmp_path / "state"), "settle": "3600", "parts": "4"}
    rows = lambda reader, a, b: sorted((os.path.basename(r[0]), r[1]) for p in reader.partitions(a, b) for r in reader.read(p))
    (root / "old.md").write_text("x")
    os.utime(root / "old.md", (1, 1))
    (root / "fresh.md").write_text("x")
    first = ChangedFilesReader(options)
    start, one = first.initialOffset(), first.latestOffset()
    assert rows(first, start, one) == [("old.md", "add")]
    # being written again it is as it was, and not gone, for a reader that begins anew too
    os.utime(root / "old.md", (time.time(), time.time()))
    again = ChangedFilesReader(options)
    assert again.latestOffset() == one
    os.utime(root / "old.md", (5, 5))
    os.utime(root / "fresh.md", (5, 5))
    two = again.latestOffset()
    assert rows(again, one, two) == [("fresh.md", "add"), ("old.md", "change")] and rows(again, start, two) == [("fresh.md", "add"), ("old.md", "add")]
    again.commit(two)
    assert sorted(os.listdir(tmp_path / "state")) == ["000000000002", "000000000002.whole"]


def test_names_that_are_passed_over():
    assert passed_over("a/.git/x.md", []) and passed_over("x.png", []) and passed_over("n/x.md", ["n"]) and passed_over("a/n/x.md", ["n"]) and passed_over("x.md", ["*.md"])
    assert not passed_over("a/n.md", ["n"]) and not passed_over("b.TXT", ["*.md"])


def test_passages_are_whole_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"{'ab' if i % 2 else 'cd'}{i}", f"text {i}\n") for i in range(20)] + [("ab1", "text 1\n"), ("zz", None)], "name string, content string")
    at = tmp_path / "out"
    passages.write_passages(rows, str(at))
    files = {str(p.relative_to(at)): p.read_text() for p in at.rglob("*.txt")}
    assert len(files) == 21 and files["ab/ab1.txt"] == "text 1\n" and files["zz/zz.txt"] == "" and not list((at / passages.ATTEMPTS).iterdir())
    # what is there is left alone
    (at / "ab" / "ab1.txt").write_text("kept")
    os.remove(at / "cd" / "cd2.txt")
    passages.write_passages(rows, str(at))
    assert (at / "ab" / "ab1.txt").read_text() == "kept" and (at / "cd" / "cd2.txt").read_text() == "text 2\n"


def test_a_killed_task_leaves_no_half_file(spark, tmp_path):
    at = tmp_path / "out"
    fails = F.udf(lambda i: str(1 // (5 - i)), "string")
    rows = spark.range(10).coalesce(1).select(F.concat(F.lit("p"), "id").alias("name"), F.concat(F.lit("text"), fails("id")).alias("content"))
    spark.dataSource.register(passages.PassageFiles)
    with pytest.raises(Exception, match="division"):
        rows.write.format("passage_files").option("path", str(at)).mode("append").save()
    assert all(p.read_text().startswith("text") for p in at.rglob("*.txt"))
    passages.write_passages(rows.where("id <> 5"), str(at))
    assert len(list(at.rglob("*.txt"))) == 9
