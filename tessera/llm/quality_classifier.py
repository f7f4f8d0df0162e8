"""Quality classifier: document evidence and the standing of its site, by hierarchical empirical Bayes.

A naive Bayes classifier on hashed n-grams of words and of their shapes gives each document a log odds of good
quality, calibrated by logistic regression on labelled documents that its counts don't come from. Labelled
documents also tell of their sites: grouped sums give good and bad counts of each path (host and first section)
and host; a host's rate is shrunk toward the global one, a path's toward its host's, with strengths estimated
from how much the groups differ beyond chance. A labelled document's own label is left out of its site's
rates. The posterior log odds of a document is its path's prior log odds plus its own evidence.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import literal_array, saved, words
from tessera.llm.quality_rules import with_grams as with_word_grams
from tessera.llm.quality_rules import with_words


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    #: Bound on the labelled documents, by label, that the document classifier is fitted from.
    max_labelled: int = 20_000
    smoothing: float = 1.0
    #: Of so many folds of their ids, the document classifier never sees the first; the second calibrates it, and the
    #: others give its counts. Sites count all.
    folds: int = 5
    #: Bounds of a group's strength, in labelled documents, toward its parent's rate.
    least_strength: float = 1.0
    most_strength: float = 1e4
    threshold: float = 0.5


@dataclass(frozen=True)
class Classifier:
    odds: list[float]
    bias: float
    slope: float


def _fold(column: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(folds))


def with_grams(df: DataFrame, buckets: int) -> DataFrame:
    """Add ``grams`` for the column ``text``: buckets of words, word pairs, and of the shapes of words.

    A shape is a word with its runs of letters and digits put by A, a and 0, and whether the word is the one before again.
    """
    shaped = F.coalesce(F.col("text"), F.lit(""))
    for run, letter in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"[0-9]+", "0")):
        shaped = F.regexp_replace(shaped, run, letter)
    shapes = F.transform(words(shaped), lambda s: F.pmod(F.xxhash64(F.lit("shape"), s), F.lit(buckets)))
    again = F.when(F.size("wh") < 2, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("wh") - 1), lambda i: F.pmod(F.xxhash64(F.lit("again"), F.get("wh", i) == F.get("wh", i - 1)), F.lit(buckets)))
    )
    rows = with_word_grams(with_words(df), buckets)
    return rows.withColumn("grams", F.concat("grams", shapes, again))


def labelled(labels: DataFrame) -> DataFrame:
    """(id, good) of all labels; null labels are left out, of repeated ones the larger counts."""
    return (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max("quality").cast("int").alias("good"))
    )


def learnable(labels: DataFrame, cfg: Settings) -> DataFrame:
    """(id, good) outside the held-out fold."""
    return labelled(labels.where(_fold("doc_id", cfg.folds) != 0))


def fitted(docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> Classifier:
    """The document classifier; without both labels it gives no evidence at all."""
    known = learnable(labels, cfg)
    some = lambda v: known.where(F.col("good") == v).orderBy(F.xxhash64("id"), "id").limit(cfg.max_labelled)
    chosen = saved(some(1).unionByName(some(0)))
    held = (_fold("id", cfg.folds) == 1).alias("held")
    sample = saved(
        with_grams(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")), cfg.buckets).select("good", "grams", held)
    )
    counts = sample.where("NOT held").select("good", F.explode("grams").alias("b")).groupBy("b").agg(F.sum("good").alias("g"), F.count(F.lit(1)).alias("n"))
    good, bad = [cfg.smoothing] * cfg.buckets, [cfg.smoothing] * cfg.buckets
    for r in counts.collect():  # as many rows as buckets at most
        good[r["b"]] += r["g"]
        bad[r["b"]] += r["n"] - r["g"]
    all_good, all_bad = sum(good), sum(bad)
    if all_good <= cfg.smoothing * cfg.buckets or all_bad <= cfg.smoothing * cfg.buckets:
        return Classifier([0.0] * cfg.buckets, 0.0, 0.0)
    odds = [math.log(g / all_good) - math.log(b / all_bad) for g, b in zip(good, bad, strict=True)]
    # calibration of the mean log odds by Newton's method; each step is one aggregation to five sums
    points = saved(sample.where("held").select("good", mean_odds(odds).alias("x")))
    if points.isEmpty():
        return Classifier([0.0] * cfg.buckets, 0.0, 0.0)
    a = b = 0.0
    for _ in range(8):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w = p * (1 - p)
        s = points.agg(
            F.sum(F.col("good") - p).alias("ga"), F.sum((F.col("good") - p) * F.col("x")).alias("gb"),
            F.sum(w).alias("aa"), F.sum(w * F.col("x")).alias("ab"), F.sum(w * F.col("x") ** 2).alias("bb"),
        ).first()
        aa, ab, bb, gb = s["aa"] + 0.1, s["ab"], s["bb"] + 0.1, s["gb"] - 0.1 * b
        det = aa * bb - ab * ab
        a, b = a + (bb * s["ga"] - ab * gb) / det, b + (aa * gb - ab * s["ga"]) / det
    return Classifier(odds, a, b)


def mean_odds(odds: list[float]) -> Column:
    table = literal_array(odds, 5)
    total = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.get(table, g.cast("int")))
    return F.when(F.size("grams") == 0, F.lit(0.0)).otherwise(total / F.size("grams"))


def _strength(groups: DataFrame, rate: Column, cfg: Settings) -> float:
    """How many documents of its own a group needs to weigh as much as its parent: a moment estimate.

    With rates spread by rho of the binomial variance beyond chance, the strength is 1 / rho - 1.
    """
    d = (F.col("good") - F.col("n") * rate) ** 2 / F.col("n") / F.greatest(rate * (1 - rate), F.lit(1e-6))
    s = groups.where("n > 0").agg(F.sum(d).alias("s"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).first()
    if not s["k"] or s["n"] <= s["k"]:
        return cfg.most_strength
    rho = (s["s"] - s["k"]) / (s["n"] - s["k"])
    return min(max(1 / rho - 1, cfg.least_strength), cfg.most_strength) if rho > 0 else cfg.most_strength


@dataclass(frozen=True)
class Strengths:
    """The global rate, and what hosts and paths are shrunk with."""

    mean: float
    host: float
    path: float


def rates(own: Column, s: Strengths) -> tuple[Column, Column]:
    """A host's and a path's rate from their counts, without one document labelled ``own`` (null: none)."""
    out, good = F.when(own.isNotNull(), 1).otherwise(0), F.coalesce(own, F.lit(0))
    host = (F.col("host_good") - good + s.host * s.mean) / (F.col("host_n") - out + s.host)
    return host, (F.col("good") - good + s.path * host) / (F.col("n") - out + s.path)


def site_rates(docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> tuple[DataFrame, Strengths]:
    """(host, path, labelled, host_rate, path_rate) of every path with a document, its counts, and the strengths; all labels count."""
    paths = saved(
        docs.select("doc_id", "host", "path")
        .join(labelled(labels), F.col("doc_id") == F.col("id"), "left")
        .groupBy("host", "path")
        .agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("good").alias("n"))
    )
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    mean = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)
    k = _strength(hosts, F.lit(mean), cfg)
    counted = hosts.select("h", F.col("good").alias("host_good"), F.col("n").alias("host_n"))
    both = saved(paths.join(counted, F.col("host").eqNullSafe(F.col("h"))).drop("h"))
    none = F.lit(None).cast("int")
    strengths = Strengths(mean, k, _strength(both, rates(none, Strengths(mean, k, 1.0))[0], cfg))
    host_rate, path_rate = rates(none, strengths)
    return both.select(
        "host", "path", F.col("n").alias("labelled"), host_rate.alias("host_rate"), path_rate.alias("path_rate"), "good", "n", "host_good", "host_n"
    ), strengths


def classified(docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Every document of (doc_id, text, host, path) with evidence, site rates, posterior score and ``kept``.

    Null text counts as empty and gives the evidence of none; null hosts and paths are sites of their own.
    Sites without labelled documents have their parent's rate; ``labelled`` and the rates of a labelled document
    are those of the others. Rows with equal ids are classified each. Extra columns of both tables are ignored;
    an empty table gives an empty result, and without both labels there is no evidence but the sites'.
    """
    model = fitted(docs, labels, cfg)
    sites, strengths = site_rates(docs, labels, cfg)
    evidence = saved(
        with_grams(docs.select("doc_id", "text", "host", "path"), cfg.buckets).select(
            "doc_id", "host", "path", (F.lit(model.bias) + F.lit(model.slope) * mean_odds(model.odds)).alias("evidence")
        )
    )
    logit = lambda c: F.log(c) - F.log(1 - c)
    odds = F.col("evidence") + logit(F.col("path_rate")) - F.lit(math.log(strengths.mean / (1 - strengths.mean)))
    own = F.col("own")
    host_rate, path_rate = rates(own, strengths)
    counts = sites.select(F.col("host").alias("h"), F.col("path").alias("p"), "good", "n", "host_good", "host_n")
    return (
        evidence.join(labelled(labels).select("id", F.col("good").alias("own")), F.col("doc_id") == F.col("id"), "left").drop("id")
        .join(counts, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
        .select(
            "doc_id", "host", "path", (F.col("n") - F.when(own.isNotNull(), 1).otherwise(0)).alias("labelled"),
            host_rate.alias("host_rate"), path_rate.alias("path_rate"), "evidence",
        )
        .withColumn("score", 1 / (1 + F.exp(-odds)))
        .withColumn("kept", F.col("score") >= cfg.threshold)
    )
