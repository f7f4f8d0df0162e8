"""Corpora in zip archives: unequal members, odd lines and broken archives."""

import json
import zipfile

from tessera.sources.archives import zip_lines, zipped_corpus


def test_members_are_read_side_by_side(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("scifact/corpus.jsonl", "".join(json.dumps({"_id": f"d{i}", "title": f"T{i}" if i % 2 else "", "text": "x " * (i % 50)}) + "\n" for i in range(5000)))
        z.writestr("scifact/queries.jsonl", '{"_id": "q", "text": "one"}\n')
        z.writestr("small/corpus.jsonl", '\n{"_id": "s", "text": "café"}\r\nnot json\n')
        z.writestr("empty/corpus.jsonl", "")
    lines = zip_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() == 4
    assert {(r["member"], r["count"]) for r in lines.groupBy("member").count().collect()} == {("scifact/corpus.jsonl", 5000), ("scifact/queries.jsonl", 1), ("small/corpus.jsonl", 3)}
    rows = zipped_corpus(spark, str(tmp_path)).collect()
    got = {r["doc_id"]: r["content"] for r in rows if r["doc_id"]}
    assert len(got) == 5001 and got["s"] == "café\n" and got["d1"] == "T1\n\nx\n" and got["d0"] == "\n"
    assert [r["error"] for r in rows if r["error"]] == ["no passage in line 3"]
    assert zipped_corpus(spark, str(tmp_path / "a.zip"), "small/*").count() == 2


def test_broken_archives_and_members_are_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("corpus.jsonl", '{"_id": "g", "text": "fine"}\n')
    with zipfile.ZipFile(tmp_path / "torn.zip", "w") as z:
        z.writestr("corpus.jsonl", '{"_id": "t", "text": "torn"}\n')
    torn = bytearray((tmp_path / "torn.zip").read_bytes())
    at = torn.index(b"torn\"}")
    torn[at : at + 4] = b"TORN"  # the member's sum is no longer right
    (tmp_path / "torn.zip").write_bytes(torn)
    (tmp_path / "none.zip").write_bytes(b"no archive at all")
    rows = zipped_corpus(spark, str(tmp_path)).collect()
    assert "g" in {r["doc_id"] for r in rows}
    bad = zip_lines(spark, str(tmp_path)).where("error IS NOT NULL").collect()
    assert sorted((r["archive"].rsplit("/", 1)[1], r["member"]) for r in bad) == [("none.zip", None), ("torn.zip", "corpus.jsonl")]
    assert sum(1 for r in rows if r["error"]) == 2
