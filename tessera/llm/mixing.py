"""Mixing sources to target weights by hash-threshold histograms.

Every document has a place in a fixed hash order. A source that must give part of its words gives those
below a hash threshold, so that a smaller budget's documents are among a larger budget's. The threshold is
found by histograms: words are summed by source and hash bucket, the bucket in which the budget runs out is
found, and only that bucket is divided again, until it holds one hash. Nothing is sorted but bucket sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved, words

#: Bits of the hash order, and how many of them one histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 10
#: No source gives more than so many times its size.
MOST_REPEATS = 3


def place(key: Column) -> Column:
    """A document's place in the hash order: the first 60 bits of its id's MD5."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """Each source's target for the table (source, source_size), one row per source.

    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the sum of all sizes. A
    target above ``most`` times its source's size is cut down to that, and the excess is shared by weight
    among the others: with sources by rising cap per weight, a prefix is cut, and the rest share what it
    leaves. The windows run over one row per source (two longs and a name) in one task: some millions of sources
    are a sort of some hundred megabytes, which spills; documents are never in it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy("__need", "__rank")
    ranked = (
        sizes.withColumn("__rank", F.row_number().over(by_name))
        .withColumn("weight", ((F.col("__rank") - 1) % 3 + 1).cast("double"))
        .withColumn("__cap", F.col("source_size") * float(most))
        .withColumn("__need", F.col("__cap") / F.col("weight"))
    )
    everything = Window.partitionBy()
    shared = (
        ranked.withColumn("__cut", F.sum("__cap").over(by_need) - F.col("__cap"))
        .withColumn("__left", F.sum("weight").over(everything) - F.sum("weight").over(by_need) + F.col("weight"))
        .withColumn("__rate", (F.sum("source_size").over(everything) - F.col("__cut")) / F.col("__left"))
        .withColumn("__is_cut", F.col("__need") <= F.col("__rate"))
        .withColumn("__rate", F.min(F.when(~F.col("__is_cut"), F.struct("__need", "__rank", "__rate"))).over(everything)["__rate"])
    )
    return shared.select(
        "source", "source_size", F.when(F.col("__is_cut"), F.col("__cap")).otherwise(F.col("__rate") * F.col("weight")).alias("target")
    )


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def thresholds(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: ``whole`` (repeats of every document), and ``cut``: documents at or below it come once more.

    ``sized`` has source, size and h (place). The remaining budget runs out in the first hash whose running
    sum exceeds it; that hash is taken if its middle lies within the budget. -1: none.
    """
    state = sources.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("whole"),
    ).withColumn("rem", F.col("target") - F.col("whole") * F.col("source_size"))
    state = state.withColumn("before", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long"))
    done, shift = None, HASH_BITS
    while shift > 0:
        state = saved(state)
        shift -= LEVEL_BITS
        inside = sized.alias("d").join(
            state.select("source", "prefix").alias("s"),
            _same_source("d", "s") & (F.shiftright(F.col("h"), shift + LEVEL_BITS) == F.col("prefix")),
        )
        sums = (
            inside.select("d.source", F.shiftright("h", shift).alias("bucket"), "size", "h")
            .groupBy("source", "bucket")
            .agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
        )
        running = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        met = (
            running.alias("r")
            .join(state.alias("s"), _same_source("r", "s"))
            .where(F.col("before") + F.col("upto") > F.col("rem"))
            .groupBy("s.source")
            .agg(
                F.min(F.struct("bucket", "upto", "words", "low", "high", "source_size", "target", "whole", "rem", "before")).alias("b")
            )
            .select(
                "source", "b.source_size", "b.target", "b.whole", "b.rem",
                (F.col("b.before") + F.col("b.upto") - F.col("b.words")).alias("before"),
                F.col("b.bucket").alias("prefix"), "b.words", "b.low", "b.high",
            )
        )
        met = saved(met)
        found = met.where((F.col("low") == F.col("high")) | F.lit(shift == 0)).select(
            "source",
            F.when(F.col("before") + F.col("words") / 2 <= F.col("rem"), F.col("low")).otherwise(F.col("low") - 1).alias("cut"),
        )
        done = found if done is None else done.unionByName(found)
        state = met.where(F.col("low") != F.col("high")).select("source", "source_size", "target", "whole", "rem", "before", "prefix")
        if state.isEmpty():
            break
    return (
        sources.alias("a")
        .join(done.alias("b"), _same_source("a", "b"), "left")
        .select(
            "a.source", "a.source_size", "a.target",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("whole"),
            F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"),
        )
    )


def mixture(docs: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """How much of each document the mix takes: doc_id, size, source_size, target, taken, copies.

    Size counts words; null text has none. A null source is a source of its own. Rows with equal ids share a
    place in the hash order, so they are taken together. An empty table gives an empty result. Extra columns
    are ignored. A source's taken words miss its target by half of one hash's words at most.
    """
    sized = saved(
        docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), place(F.col("doc_id")).alias("h"))
    )
    sources = saved(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most))
    plan = saved(thresholds(sized.select("source", "size", "h"), sources))
    copies = F.col("whole") + F.when(F.col("h") <= F.col("cut"), 1).otherwise(0)
    return (
        sized.alias("d")
        .join(plan.alias("p"), _same_source("d", "p"))
        .select(
            "doc_id", "size", "source_size", F.round("target", 6).alias("target"),
            (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"), "h", "d.source",
        )
    )


def mixed_documents(docs: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns; wordless ones at most as often."""
    sized = docs.select("source", F.size(words(F.col("text"))).cast("long").alias("size"), place(F.col("doc_id")).alias("h"))
    sized = saved(sized)
    sources = saved(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most))
    plan = saved(thresholds(sized, sources))
    copies = F.col("p.whole") + F.when(place(F.col("d.doc_id")) <= F.col("p.cut"), 1).otherwise(0)
    return (
        docs.alias("d")
        .join(plan.alias("p"), _same_source("d", "p"))
        .withColumn("__copies", copies.cast("int"))
        .where("__copies > 0")
        .select("d.*", F.explode(F.array_repeat(F.lit(1), F.col("__copies"))).alias("__one"))
        .drop("__one")
    )


MIXTURE_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rk, source_size * 3.0::DOUBLE AS cap FROM totals
), shares AS (
  SELECT *, cap / weight AS need,
         sum(cap) OVER (ORDER BY cap / weight, rk) - cap AS gone,
         sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, rk) + weight AS open_weight,
         sum(source_size) OVER () AS everything FROM ranked
), rated AS (
  SELECT *, (everything - gone) / open_weight AS rate, need <= (everything - gone) / open_weight AS is_cut FROM shares
), target AS (
  SELECT source, source_size, CASE WHEN is_cut THEN cap ELSE weight * (SELECT arg_min(rate, need) FROM rated WHERE NOT is_cut) END AS target FROM rated
), budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM target
), placed AS (
  SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS rem,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM sized d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST((whole + CASE WHEN rem > 0 AND upto - own + own / 2.0 <= rem THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
"""
