"""Full-text index and BM25 over phrases.

An index is a forward one (chunk_id, tokens, dl), which a batch of queries scans once, an inverted one (term,
chunk_id, dl, positions), of which a few queries read the terms they hold, or a stored one (``Inverted``), of which
only what the dictionary says is needed is read. In all, a phrase is looked for only where its rarest term occurs, and
tokens that no query asks for are left behind before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.han import Segmenter, bigrams
from tessera.functions.text import expanded_for_index, tokens
from tessera.operators.scratch import broadcast_if_small, saved

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: The average length that stored ratios are made with; searches turn them to the corpus's own.
USUAL_LENGTH = 256.0


@dataclass(frozen=True)
class Inverted:
    """What a stored index gives to read.

    ``terms`` of asked terms (term): term, tier, df, cf, least and most (the range of ``ratio_of``), exact for the
    live chunks. ``postings`` of wanted rows (term, tier and others): these with chunk_id, dl, tf and positions.
    ``tokens`` of rows with a chunk_id: these with the chunk's tokens.
    """

    terms: Callable[[DataFrame], DataFrame]
    postings: Callable[[DataFrame], DataFrame]
    tokens: Callable[[DataFrame], DataFrame]


def ratio_of(tf: Column, dl: Column) -> Column:
    """Length over frequency, of which the weight of a term in a chunk falls; made with the usual average length."""
    return (1 - B + B * dl / USUAL_LENGTH) / tf


def _weights(ratio: Column, avgdl: float) -> tuple[Column, Column]:
    """The least and the most that a term with such a ratio can weigh, times idf, for another average length."""
    turned = USUAL_LENGTH / avgdl
    weight = lambda r: (K1 + 1) / (1 + K1 * r)
    return weight(ratio * max(1.0, turned)), weight(ratio * min(1.0, turned))


def analyzed(chunks: DataFrame, key: str = "chunk_id", text: str = "content", segmenter: Segmenter = bigrams, kept: list[str] | None = None) -> DataFrame:
    """The forward index: chunk_id, tokens and dl (their number), or the columns ``kept`` with these. Han text is indexed with its segments besides."""
    whole = F.col(text)
    own = [F.col(key).alias("chunk_id")] if kept is None else [F.col(c) for c in kept]
    rows = chunks.select(*own, tokens(expanded_for_index(whole, segmenter(whole))).alias("tokens"))
    return rows.withColumn("dl", F.size("tokens"))


def postings(analyzed_: DataFrame) -> DataFrame:
    """The inverted index: term, chunk_id, dl, positions; one row per term and chunk, so that no term's list is one row."""
    return (
        analyzed_.select("chunk_id", "dl", F.posexplode("tokens").alias("pos", "term"))
        .groupBy("term", "chunk_id", "dl")
        .agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    )


def statistics(analyzed_: DataFrame) -> DataFrame:
    """n and avgdl of the whole corpus; filters on results never change them."""
    return analyzed_.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))


def term_counts(analyzed_: DataFrame) -> DataFrame:
    """term, df (chunks that hold it) and cf (its occurrences), in one pass that combines before it shuffles."""
    once = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf")))
    each = F.transform("tokens", lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf")))
    return analyzed_.select(F.explode(F.concat(once, each)).alias("t")).groupBy("t.term").agg(F.sum("t.df").alias("df"), F.sum("t.cf").alias("cf"))


def idf(n: float, df: Column) -> Column:
    return F.greatest(F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))


def _anchored(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Each phrase (query_id, phrase_id, phrase) with its rarest term and that term's place: term, shift."""
    terms = broadcast_if_small(asked.select(F.explode("phrase").alias("term")).distinct())
    held = index.select(F.explode(F.array_distinct("tokens")).alias("term")) if "tokens" in index.columns else index.select("term")
    df = held.join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    placed = asked.select("query_id", "phrase_id", "phrase", F.posexplode("phrase").alias("shift", "term"))
    rarest = placed.join(df, "term").groupBy("query_id", "phrase_id").agg(
        F.min(F.struct("df", "shift", "term")).alias("a"), F.first("phrase").alias("phrase"), F.count(F.lit(1)).alias("known")
    )
    # a phrase with a term that no chunk holds is held by none
    return rarest.where(F.col("known") == F.size("phrase")).select("query_id", "phrase_id", "phrase", "a.term", "a.shift")


def phrase_hits(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, phrase_id, chunk_id, dl, tf for queries (query_id, phrases)."""
    asked = queries.select("query_id", F.posexplode("phrases").alias("phrase_id", "phrase")).where(F.size("phrase") > 0)
    longest = asked.agg(F.max(F.size("phrase")).alias("n")).first()["n"] or 0
    anchors = _anchored(asked, index) if longest > 1 else asked.select("query_id", "phrase_id", "phrase", F.get("phrase", F.lit(0)).alias("term"), F.lit(0).alias("shift"))
    anchors = broadcast_if_small(anchors)
    key = ("query_id", "phrase_id", "chunk_id", "dl")
    if "tokens" in index.columns:
        places = index.select("chunk_id", "dl", "tokens", F.posexplode("tokens").alias("pos", "term"))
        if longest <= 1:
            met = places.select("chunk_id", "dl", "term").join(anchors, "term")
        else:
            here = F.slice("tokens", F.col("pos") - F.col("shift") + 1, F.size("phrase")) == F.col("phrase")
            met = places.join(anchors, "term").where((F.col("pos") >= F.col("shift")) & here)
        return met.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("tf"))
    found = index.join(anchors, "term")
    if longest <= 1:
        return found.select(*key, F.size("positions").alias("tf"))
    # starts that the rarest term allows; every other term of the phrase must allow them too
    starts = found.select(*key, "phrase", F.explode("positions").alias("pos"), "shift").select(*key, "phrase", (F.col("pos") - F.col("shift")).alias("start")).where("start >= 0")
    wanted = starts.select(*key, "start", F.size("phrase").alias("n_terms"), F.posexplode("phrase").alias("shift", "term"))
    terms = broadcast_if_small(asked.select(F.explode("phrase").alias("term")).distinct())
    held = index.join(terms, "term").select("chunk_id", "term", F.explode("positions").alias("pos"))
    met = wanted.withColumn("pos", F.col("start") + F.col("shift")).join(held, ["chunk_id", "term", "pos"])
    whole = met.groupBy(*key, "start", "n_terms").agg(F.count(F.lit(1)).alias("k")).where("k = n_terms")
    return whole.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("tf"))


def _needed_tiers(terms: DataFrame, n: int, avgdl: float, limit: int, slack: float) -> DataFrame:
    """The tiers of each term that may hold one of its ``limit`` best chunks, told by the dictionary alone.

    Where tiers that weigh at least w hold ``limit`` chunks, tiers that weigh less than w hold none of the best; what
    is within ``slack`` (of scores that will be rounded) counts as equal.
    """
    every = Window.partitionBy("term")
    least, most = _weights(F.col("most"), avgdl)[0], _weights(F.col("least"), avgdl)[1]
    weighed = terms.withColumn("w", idf(n, F.sum("df").over(every))).withColumns({"low": F.col("w") * least, "high": F.col("w") * most})
    falling = every.orderBy(F.col("low").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    enough = weighed.withColumn("upto", F.sum("df").over(falling))
    return enough.withColumn("floor", F.max(F.when(F.col("upto") >= limit, F.col("low"))).over(every)).where(
        F.col("floor").isNull() | (F.col("high") + slack >= F.col("floor"))
    ).select("term", "tier")


#: Places that phrases may begin at which are held against tokens at once; more are confirmed by a second term before.
FEW_STARTS = 100_000


def stored_hits(queries: DataFrame, index: Inverted, n: int, avgdl: float, limit: int | None = None, slack: float = 0.0) -> tuple[DataFrame, DataFrame, int]:
    """``phrase_hits`` of a stored index, the frequencies (query_id, phrase_id, df) of phrases of one term, and the number of phrases.

    The dictionary names each phrase's rarest terms. Postings of the rarest are read, and where they are many, those
    of the next rarest confirm them; longer phrases are then held against the tokens of the chunks that are left. With
    ``limit``, of queries that are one term only the tiers that may hold one of the best are read.
    """
    asked = saved(queries.select("query_id", F.posexplode("phrases").alias("phrase_id", "phrase")).where(F.size("phrase") > 0))
    known = asked.agg(F.count(F.lit(1)).alias("phrases"), F.sum(F.size("phrase")).alias("terms"), F.count_if(F.size("phrase") > 1).alias("longer")).first()
    phrases, longest = known["phrases"], known["longer"]
    terms = saved(index.terms(asked.select(F.explode("phrase").alias("term")).distinct()))
    df = broadcast_if_small(terms.groupBy("term").agg(F.sum("df").alias("df")), rows=known["terms"] or 0)
    placed = asked.select("query_id", "phrase_id", "phrase", F.posexplode("phrase").alias("shift", "term"))
    rare = placed.join(df, "term").groupBy("query_id", "phrase_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("df", "shift", "term"))), 1, 2).alias("r"), F.first("phrase").alias("phrase"), F.count(F.lit(1)).alias("known")
    )
    # a phrase with a term that no chunk holds is held by none
    anchors = saved(rare.where(F.col("known") == F.size("phrase")).select(
        "query_id", "phrase_id", "phrase", F.get("r", 0)["term"].alias("term"), F.get("r", 0)["shift"].alias("shift"), F.get("r", 0)["df"].alias("df"),
        F.get("r", 1)["term"].alias("second"), F.get("r", 1)["shift"].alias("second_shift"),
    ))
    key = ("query_id", "phrase_id", "chunk_id", "dl")
    tiers = broadcast_if_small(terms.select("term", "tier"), rows=4 * (known["terms"] or 0))
    single = anchors.where(F.size("phrase") == 1)
    parts = []
    if longest < phrases:
        wanted = single.select("query_id", "phrase_id", "term")
        if limit is None:
            wanted = wanted.join(tiers, "term")
        else:
            alone = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("k")).where("k = 1").select("query_id")
            best = broadcast_if_small(saved(_needed_tiers(terms, n, avgdl, limit, slack)))
            wanted = wanted.join(alone, "query_id", "left_semi").join(best, "term").unionByName(wanted.join(alone, "query_id", "left_anti").join(tiers, "term"))
        parts.append(index.postings(wanted.select("query_id", "phrase_id", "term", "tier")).select(*key, "tf"))
    if longest:
        longer = anchors.where(F.size("phrase") > 1).drop("df").join(tiers, "term")
        first = index.postings(longer).select(*key, "phrase", "second", "second_shift", F.explode("positions").alias("pos"), "shift")
        left = saved(first.withColumn("start", F.col("pos") - F.col("shift")).where("start >= 0").drop("pos", "shift"))
        if left.count() > FEW_STARTS:
            # postings of the second term meet what the first left by term and chunk
            second = index.postings(left.select(F.col("second").alias("term")).distinct().join(tiers, "term")).select(F.col("term").alias("second"), "chunk_id", "positions")
            met = left.hint("merge").join(second, ["second", "chunk_id"])
            left = saved(met.where(F.array_contains("positions", F.col("start") + F.col("second_shift"))).drop("positions"))
        some = index.tokens(left.select("chunk_id").distinct())
        held = left.join(some, "chunk_id").where(F.slice("tokens", F.col("start") + 1, F.size("phrase")) == F.col("phrase"))
        parts.append(held.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("tf")))
    nothing = asked.select("query_id", "phrase_id", F.lit(0).cast("long").alias("chunk_id"), F.lit(0).alias("dl"), F.lit(0).alias("tf")).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts, nothing), single.select("query_id", "phrase_id", "df"), phrases


def bm25(queries: DataFrame, index: DataFrame | Inverted, stats: DataFrame, limit: int | None = None, digits: int | None = None) -> DataFrame:
    """query_id, chunk_id, score: summed over a query's phrases, with corpus-wide statistics.

    The hits, slim rows of ids and counts, are written once, since both a phrase's frequency and the scores need them.
    With ``limit``, a stored index may leave out chunks that aren't among a query's best; scores are rounded to
    ``digits``, so that equal texts tie.
    """
    known = stats.first()
    n, avgdl = known["n"], known["avgdl"] or 1.0
    if isinstance(index, Inverted):
        found, df, phrases = stored_hits(queries, index, n, avgdl, limit, 10.0**-digits if digits is not None else 0.0)
        hits = saved(found)
        # a term's frequency is the dictionary's, since not all of its hits may have been read
        counted = hits.join(broadcast_if_small(df, rows=phrases), ["query_id", "phrase_id"], "left_anti")
        df = df.unionByName(counted.groupBy("query_id", "phrase_id").agg(F.count(F.lit(1)).alias("df")))
    else:
        hits, phrases = saved(phrase_hits(queries, index)), None
        df = hits.groupBy("query_id", "phrase_id").agg(F.count(F.lit(1)).alias("df"))
    tf = F.col("tf").cast("double")
    part = idf(n, F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl))))
    scored = hits.join(broadcast_if_small(df, rows=phrases), ["query_id", "phrase_id"]).groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    return scored if digits is None else scored.withColumn("score", F.round("score", digits))


def top(scored: DataFrame, limit: int, *tie: str, group: str = "query_id", score: str = "score") -> DataFrame:
    """The first ``limit`` rows of each group by falling score; adds rank from 1."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), *(tie or ("chunk_id",)))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
