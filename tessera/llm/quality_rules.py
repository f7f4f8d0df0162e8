"""Quality rules: counting rules, and a hashed n-gram log-likelihood ratio between two multinomials.

Word unigrams and bigrams are hashed into a fixed number of buckets. One multinomial over the buckets is
estimated from trusted documents, one from the whole raw corpus; a document's evidence is the mean over
its n-grams of the log ratio of the two, and every document is kept or rejected by a fixed threshold on it.

Only DataFrame functions run here, inside the JVM; nothing is shuffled but bucket counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, WORD, literal_array, sealed, words


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    #: Largest share, in percent, of words that lie in repeated windows.
    max_repeat_percent: int = 20
    window: int = 5
    buckets: int = 1 << 14
    #: Bound on the trusted documents that the target multinomial is estimated from.
    max_trusted: int = 20_000
    #: Add-so-much smoothing of both multinomials.
    smoothing: float = 1.0
    #: Least mean log ratio of a kept document.
    threshold: float = -0.15


def with_words(df: DataFrame) -> DataFrame:
    """Add ``w`` (words) and ``wh`` (their hashes) for the column ``text``."""
    return df.withColumn("w", words(F.col("text"))).withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))


def with_grams(df: DataFrame, buckets: int) -> DataFrame:
    """Add ``grams``: the buckets of all unigrams and bigrams of ``wh``."""
    n = F.size("wh")
    bigrams = F.when(n < 2, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), n - 2),
            lambda i: F.pmod(F.xxhash64(F.get(F.col("wh"), i), F.get(F.col("wh"), i + 1)), F.lit(buckets)),
        )
    )
    return df.withColumn("grams", F.concat(F.transform("wh", lambda h: F.pmod(h, F.lit(buckets))), bigrams))


def with_base(df: DataFrame, rules: Rules) -> DataFrame:
    """Add the counts of the base rules for the columns ``text``, ``w`` and ``wh``."""
    text, k = F.coalesce(F.col("text"), F.lit("")), rules.window
    windows = F.when(F.size("wh") < k, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.size("wh") - k),
            lambda i: F.xxhash64(*[F.get(F.col("wh"), i + j) for j in range(k)]),
        )
    )
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    # windows with their places, sorted, only where some window repeats
    ranked = F.when(
        F.size(F.array_distinct("__win")) < F.size("__win"),
        F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    twice = F.filter(
        F.col("__ranked"),
        lambda x, j: (x["h"] == F.get(F.col("__ranked"), j + 1)["h"])
        | ((j > 0) & (x["h"] == F.get(F.col("__ranked"), j - 1)["h"])),
    )
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct(
            (a["n"] + p + k - F.greatest(p, a["end"])).alias("n"), (p + k).alias("end")
        ),
        lambda a: a["n"],
    )
    return (
        df.withColumn("__win", windows)
        .withColumn("__lines", lines)
        .withColumn("__ranked", ranked)
        .withColumn("n_words", F.size("w").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(text, SPACE, "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("n_repeat_words", F.when(F.size("__ranked") == 0, F.lit(0)).otherwise(covered).cast("long"))
        .withColumn(
            "base_failed",
            (F.col("n_words") < rules.min_words)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent),
        )
        .drop("__win", "__lines", "__ranked")
    )


def log_ratios(docs: DataFrame, labels: DataFrame, rules: Rules) -> list[float]:
    """The log ratio of trusted to raw probability for every bucket.

    Raw counts cover all documents; trusted ones are those labelled of good quality, at most
    ``max_trusted`` of them (those of the least hashed ids). Without trusted documents all ratios are 0.
    """
    trusted = (
        labels.where(F.col("quality") == 1)
        .select(F.col("doc_id").alias("__id"))
        .where(F.col("__id").isNotNull())
        .distinct()
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(rules.max_trusted)
        .withColumn("__target", F.lit(1))
    )
    counts = (
        with_grams(with_words(docs.select("doc_id", "text").join(F.broadcast(trusted), F.col("doc_id") == F.col("__id"), "left")), rules.buckets)
        .select(F.coalesce("__target", F.lit(0)).alias("t"), F.explode_outer("grams").alias("b"))
        .groupBy("b")
        .agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("r"))
    )
    target, raw = [0] * rules.buckets, [0] * rules.buckets
    for row in counts.where("b IS NOT NULL").collect():  # as many rows as buckets at most
        target[row["b"]], raw[row["b"]] = row["t"], row["r"]
    all_t, all_r, a = sum(target), sum(raw), rules.smoothing
    if not all_t:
        return [0.0] * rules.buckets
    t_sum, r_sum = math.log(all_t + a * rules.buckets), math.log(all_r + a * rules.buckets)
    return [math.log(t + a) - t_sum - math.log(r + a) + r_sum for t, r in zip(target, raw, strict=True)]


def evidence(ratios: list[float]) -> Column:
    """Mean log ratio of a document's n-grams; 0 without any."""
    table = literal_array(ratios, 5)
    total = F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(table, b.cast("int")))
    return F.when(F.size("grams") == 0, F.lit(0.0)).otherwise(total / F.size("grams"))


def judged(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every document with its counts, its evidence and the verdict ``kept``.

    Null text counts as empty, and a document of under ``min_words`` words always fails. Rows with equal
    ids are judged each by its own text. Labels whose document is missing, null labels and repeated labels
    change nothing. Extra columns of the input are ignored; an empty table gives an empty result.
    """
    ratios = log_ratios(docs, labels, rules)
    rows = with_base(with_words(docs.select("doc_id", "text")), rules)
    counted = with_grams(rows, rules.buckets).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        evidence(ratios).alias("evidence"),
    )
    return sealed(counted).withColumn("kept", ~F.col("base_failed") & (F.col("evidence") >= rules.threshold))


def kept_documents(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns."""
    ratios = log_ratios(docs, labels, rules)
    whole = docs.select(F.struct("*").alias("__row"), F.col("text").alias("text"))
    rows = with_grams(with_base(with_words(whole), rules), rules.buckets)
    kept = ~F.col("base_failed") & (evidence(ratios) >= rules.threshold)
    return sealed(rows.select("__row", kept.alias("__kept"))).where("__kept").select("__row.*")
