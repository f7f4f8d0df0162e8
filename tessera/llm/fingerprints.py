"""Document fingerprints: a threshold-scaled sketch of shingle hashes.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash space. Sketches of
unequal documents stay comparable (the same hashes are eligible in both), and the sketch of a union
is the union of the sketches. A text of which no hash lies below the threshold keeps its least hash
alone, so that no text with a word has an empty fingerprint; a merge keeps that rule by dropping
hashes above the threshold unless nothing is below it, and then keeping the least.

Only DataFrame functions run here, inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import block_of, literal_longs, range_blocks, sealed, words

SHINGLE = 5
#: A hash is kept if it is below this share of the space of 2**64.
FRACTION = 1 / 4


def _limit(fraction: float) -> int:
    return -(1 << 63) + int(fraction * (1 << 64)) - 1


def with_sketch(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Add ``out``: the sorted distinct kept hashes (array of long) of the column ``text``.

    Null and wordless texts get an empty array. A text of fewer words than a shingle is one shingle.
    """
    w, n = f"__{out}_w", F.size(f"__{out}_w")
    hashes = F.when(n == 0, F.array().cast("array<bigint>")).when(
        n < shingle, F.array(F.xxhash64(F.array_join(w, " ")))
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), n - shingle),
            lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(shingle)]),
        )
    )
    low = F.filter(F.col(f"__{out}_h"), lambda h: h <= F.lit(_limit(fraction)))
    return (
        df.withColumn(w, words(F.col(text)))
        .withColumn(f"__{out}_h", hashes)
        .withColumn(f"__{out}_l", F.sort_array(F.array_distinct(low)))
        .withColumn(
            out,
            F.when((F.size(f"__{out}_l") > 0) | (n == 0), F.col(f"__{out}_l")).otherwise(F.array(F.array_min(f"__{out}_h"))),
        )
        .drop(w, f"__{out}_h", f"__{out}_l")
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches; 1 for two empty ones, 0 for one."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first document that the second holds; 1 if the first is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two documents taken together."""
    union = F.sort_array(F.array_union(a, b))
    low = F.filter(union, lambda h: h <= F.lit(_limit(fraction)))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(union, 1, 1))


def as_text(sketch: Column) -> Column:
    """Hashes in hex, comma-joined; empty for an empty sketch."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ",")


def with_next(
    df: DataFrame, key: str, carried: list[str], rows_per_block: int = 256, prepare: Callable[[DataFrame], DataFrame] = lambda d: d
) -> DataFrame:
    """Add ``next_<c>`` for each carried column: its value in the row with the next key; the last row gets the first's.

    Rows go to blocks of neighbouring keys, so that each text is shuffled once. The rows of a block's
    least key also go to the block before (the first block's to the last), where they only serve as the
    successor. Rows of equal key are ordered by the carried columns; null keys come first. A table of one
    row is its own successor. An empty table gives an empty result. ``prepare`` may add columns that are
    cheaper to compute than to shuffle; it runs on the shuffled rows.
    """
    bounds = range_blocks(df, key, rows_per_block)
    if not bounds:
        return prepare(df).select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    n = len(bounds)
    least = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))) == F.get(
        literal_longs(bounds), F.col("__block")
    )
    placed = (
        df.withColumn("__block", block_of(key, bounds))
        .withColumn(
            "__to",
            F.when(least, F.array(
                F.struct(F.col("__block").alias("at"), F.lit(0).alias("guest")),
                F.struct(F.pmod(F.col("__block") - 1, F.lit(n)).alias("at"), F.lit(1).alias("guest")),
            )).otherwise(F.array(F.struct(F.col("__block").alias("at"), F.lit(0).alias("guest")))),
        )
        .select("*", F.explode("__to").alias("__copy"))
        .select(*df.columns, F.col("__copy.at").alias("__at"), F.col("__copy.guest").alias("__guest"))
    )
    order = Window.partitionBy("__at").orderBy("__guest", F.col(key).asc_nulls_first(), *carried)
    return (
        prepare(placed.repartition(F.col("__at")))
        .select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
        .where("__guest = 0")
        .drop("__at", "__guest")
    )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, and how it compares with an edited copy and with the next document.

    The edited text keeps a text's first half and takes the rest from the next document. Null text
    counts as empty; empty texts have an empty fingerprint, which is like itself (1) and unlike any
    other (0). Rows with equal keys are all kept. Extra columns of the input are ignored.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pairs = with_next(base, "doc_id", ["text", "sketch"], prepare=lambda d: with_sketch(d, "text", "sketch"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), (F.length("text") - half)),
        F.substring(F.col("next_text"), F.lit(1), half),
    )
    out = with_sketch(pairs.withColumn("edited", edited), "edited", "edited_sketch")
    return sealed(out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"),
    ))
