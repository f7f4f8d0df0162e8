import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ("id", "w", "wh", "grams", "key", "n", "h", "block", "copies", "cut", "whole", "component", "c", "x", "rank", "score", "kept", "host2")


def sentence(r, n):
    return " ".join("".join(r.choice(("an", "er", "lo", "mi", "ta", "su")) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank, one-word and very long texts, ties and repeated rows."""
    r = random.Random(1)
    long_text = sentence(r, 30_000)
    plain = [(i, sentence(r, r.randint(12, 120)) + ".", "en", f"s{i % 3}", None) for i in range(10, 40)]
    odd = [
        (1, None, "en", "s0", 0), (2, "", "en", "s0", 0), (3, " \n\t ", None, "s1", 4), (4, "word", "en", None, 4), (5, "word", "de", None, 4),
        (6, long_text, "en", "s2", None), (7, "a b c d e f g h i j k l", "en", "s0", 23), (7, "a b c d e f g h i j k l", "en", "s0", 23),
        (7, "quite another text under one id that goes on for some words", "en", "s0", None), (None, "no id here but enough words to count for something", "en", "s1", None),
        (8, "naïve café 漢字 🙂  x", "fr", "s1", None),
    ]
    return odd + plain


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, edge_docs):
    from pyspark.sql import functions as F

    return edge_docs.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i % 4 == 0)) for i in range(1, 40)] + [(7, 1, 1), (7, 0, 0), (None, 1, 1), (11, None, None), (9999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
