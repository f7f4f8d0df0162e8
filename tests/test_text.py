import random
import sqlite3
import unicodedata

from pyspark.sql import functions as F

from tessera.functions.codecs import cache_key, docid, docid_value, relative_path, safe_name
from tessera.functions.responses import _FOLD, _TOKEN
from tessera.functions.text import distinct_queries, expanded_for_index, phrases_of, snippet, title_of, tokens


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return rows.select(column.alias("v")).first()["v"]


def test_tokens_fold_single_accents_only(spark):
    text = "Árbol's ñandú—ß œuvre x² don't_go‍now"
    assert one(spark, tokens(F.lit(text))) == ["arbol", "s", "nandu", "ß", "œuvre", "x²", "don", "t", "go", "now"]
    assert one(spark, tokens(F.lit(None).cast("string"))) == []


def test_query_without_han_is_one_phrase(spark):
    assert one(spark, phrases_of(F.lit("Hello  World"))) == [["hello", "world"]]
    assert one(spark, phrases_of(F.lit("  ?! "))) == []


def test_han_query_is_phrase_or_segments(spark):
    parts = F.array(F.lit("数据库"), F.lit("连接"), F.lit("数据库"))
    assert one(spark, phrases_of(F.lit("数据库连接"), parts)) == [["数据库连接"], ["数据库"], ["连接"]]
    assert one(spark, phrases_of(F.lit("数据库"), F.array(F.lit("数据库")))) == [["数据库"]]
    assert one(spark, expanded_for_index(F.lit("向量数据库"), F.array(F.lit("向量"), F.lit(" "), F.lit("数据库"), F.lit("向量")))) == "向量数据库 向量 数据库"
    assert one(spark, expanded_for_index(F.lit("plain"), F.array(F.lit("pl")))) == "plain"


def test_expansions_keep_the_original_first(spark):
    more = F.array(F.lit("b"), F.lit("a"), F.lit("b"))
    assert one(spark, distinct_queries(F.lit("a"), more)) == ["a", "b"]
    assert one(spark, distinct_queries(F.lit("a"), F.lit(None).cast("array<string>"))) == ["a"]


def test_titles(spark):
    assert one(spark, title_of(F.lit("x\n### A title  \n# B"), F.lit("/a/b.md"))) == "A title"
    assert one(spark, title_of(F.lit("##### too deep"), F.lit("/a/notes.v2.txt"))) == "notes.v2"


def test_snippet_window(spark):
    text = "a" * 300 + " needle\nin " + "b" * 300
    s = one(spark, snippet(F.lit(text), F.lit("x needle")))
    assert s.startswith("…") and s.endswith("…") and "needle in" in s and len(s) == 182
    assert one(spark, snippet(F.lit("short"), F.lit("zz"))) == "short"


def test_codecs(spark):
    assert one(spark, docid(F.lit(255))) == "0000ff" and one(spark, docid(F.lit(2**28))) == "10000000"
    assert one(spark, docid_value(F.lit("0000ff"))) == 255 and one(spark, docid_value(F.lit("12zz"))) is None
    assert one(spark, safe_name(F.lit("a/b?c>~é"))) == "YS9iP2M-fsOp"
    assert one(spark, relative_path(F.lit("/r/a/x.md"), F.lit("/r/a"))) == "x.md"
    assert one(spark, relative_path(F.lit("/r/ab/x.md"), F.lit("/r/a"))) == "/r/ab/x.md"
    assert one(spark, cache_key("expand", "m", F.lit("q"))) == "expand:m:q"


def fts_tokens(texts):
    """The tokens of SQLite's full-text index, in order."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'unicode61 remove_diacritics 1')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t (rowid, x) VALUES (?, ?)", list(enumerate(texts)))
    out = [[] for _ in texts]
    for term, doc, *_ in con.execute("SELECT * FROM v ORDER BY doc, offset"):
        out[doc].append(term)
    return out


def test_letters_fold_as_in_the_full_text_index(spark):
    # SQLite's tables are those of Unicode 6.1: letters that came later are folded here and not there
    known = lambda c: unicodedata.ucd_3_2_0.category(c) != "Cn"
    letters = [c for c in map(chr, range(0x80, 0x3000)) if unicodedata.category(c)[0] == "L"]
    texts = [f"q{c}z" for c in letters]
    got = [r["t"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", tokens(F.col("x")).alias("t")).orderBy("i").collect()]
    unlike = [c for c, a, b in zip(letters, got, fts_tokens(texts), strict=True) if a != b]
    assert not [c for c in unlike if known(c)] and len(unlike) < 150


def test_mixtures_fold_as_in_the_full_text_index(spark):
    r = random.Random(2)
    marks = [chr(c) for c in (0x300, 0x301, 0x302, 0x303, 0x308, 0x30A, 0x30C, 0x323, 0x327, 0x328)]
    alphabet = [*"abcXYZ019 -_.,", *"éÀçÑøÆßŠčİıΣςΆάЙйёǣǽſµ", "漢", "字", "ア", "", *marks]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(2000)] + ["Čapek", "cafés", "İstanbul", "́ x", "a-́b"]
    got = [r["t"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", tokens(F.col("x")).alias("t")).orderBy("i").collect()]
    assert got == fts_tokens(texts)
    # what marks matches in Python has the same tokens
    assert [[t.translate(_FOLD) for t in _TOKEN.findall(x)] for x in texts] == got
