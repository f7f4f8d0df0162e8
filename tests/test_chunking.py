from tessera.operators.chunking import chunked, chunks_of, tail


def test_sections_follow_headings():
    text = "# A\nintro\n## B\nbody\n# C\nlast\n##### deep is body\n"
    got = [(c[1], c[2], c[3]) for c in chunks_of(text, True)]
    assert got == [("# A", 1, 2), ("# A > ## B", 3, 4), ("# C", 5, 8)]
    assert list(chunks_of(text, True))[1][0] == "# A\nintro\n## B\nbody"


def test_paragraphs_and_blank_documents():
    got = list(chunks_of("Hello world\n\nSecond paragraph.", False))
    assert [(c[0], c[2], c[3]) for c in got] == [("Hello world", 1, 1), ("Hello world\nSecond paragraph.", 3, 3)]
    assert list(chunks_of(" \n\t", True)) == [] == list(chunks_of(None, False))


def test_long_sections_are_split_between_words():
    for text, markdown in (("word " * 3000, False), ("# T\n" + "abcdefghij " * 500, True), ("hello world " * 600, False)):
        got = [c[0] for c in chunks_of(text, markdown)]
        assert len(got) >= 2 and all(len(c) <= 4096 for c in got)
        words = set(text.split())
        assert all(c.split()[0] in words for c in got)
        assert all(a[-200:].split()[1] in b for a, b in zip(got, got[1:], strict=False))


def test_a_word_without_end_ends_the_walk():
    assert [len(c[0]) for c in chunks_of("x" * 9000, False)] == [3600]


def test_carriage_return_is_no_heading():
    assert [c[1] for c in chunks_of("# A\r\ntext", True)] == [None]


def test_tail_begins_at_a_word():
    assert tail("one two three", 6) == "three" and tail("one two", 100) == "one two" and tail("abcdefgh", 3) == ""


def test_chunk_table(spark):
    docs = spark.createDataFrame([(1, "# A\nx", True), (2, None, False), (3, "p\n\nq", False)], "doc_id long, content string, markdown boolean")
    rows = sorted(map(tuple, chunked(docs).select("doc_id", "chunk_idx", "embedding_content", "token_count").collect()))
    assert rows == [(1, 0, "# A\n\n# A\nx", 2), (3, 0, "p", 1), (3, 1, "p\nq", 1)]
