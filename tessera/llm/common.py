"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.catalog import numbered  # noqa: F401
from tessera.operators.scratch import broadcast_if_small, saved, settled, shared_dir  # noqa: F401  the corpus operators' way to them

#: White space that separates words in every contract: space and the six ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: What a word is made of.
WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for null, empty or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def sealed(df: DataFrame) -> DataFrame:
    """The same rows, with a border that filters can't be pushed across.

    A filter on a computed array would otherwise be pushed below the projection that computes it, and its
    copy of the expression be evaluated anew for every element of a higher-order function.
    """
    return df.select(F.explode_outer(F.array(F.struct("*"))).alias("__s")).select("__s.*")


def clash_free(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, so that extra columns of the input can't clash with an operator's own."""
    return df.select(*[df[n] for n in names])


def literal_array(values: Sequence[float], digits: int = 6) -> Column:
    """A bounded model vector as one constant (an array of doubles), which Spark folds while planning."""
    return F.split(F.lit(",".join(repr(round(float(v), digits)) for v in values)), ",").cast("array<double>")


def literal_longs(values: Sequence[int]) -> Column:
    """A bounded array of integers as one constant."""
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast("array<bigint>")


def range_blocks(df: DataFrame, key: str, rows_per_block: int, max_blocks: int = 1 << 17) -> list[int]:
    """Ascending lower bounds of blocks of about ``rows_per_block`` rows in the order of an integer key.

    Keys are drawn by their hash, so that reruns agree, eight for each block; every eighth in their order, found by
    numbering them in ranges, is a bound, so that blocks are about even. The first is the least key, and null
    counts as the least possible long. About ``max_blocks`` bounds come to the driver at most: one block is one
    group of rows to sort or walk, and a larger table has larger blocks, which their users spill or stream
    through. Rows of one key share a block.
    """
    k = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    whole = df.select(F.count(F.lit(1)).alias("n"), F.min(k).alias("low")).first()
    if not whole["n"]:
        return []
    drawn_of = max(1, max(rows_per_block, -(-whole["n"] // max_blocks)) // 8)
    drawn = saved(df.select(k.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(drawn_of)) == 0).distinct())
    bounds = numbered(drawn, ["k"], "i").where("i % 8 = 0").select("k")
    return sorted({whole["low"], *(r["k"] for r in bounds.collect())})


def block_of(key: str, bounds: list[int]) -> Column:
    """The index of the block that a key falls in: binary search in a literal array, step by step."""
    x = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    table_ = literal_longs(bounds)
    steps = [1 << i for i in reversed(range(max(1, len(bounds).bit_length())))]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when((at + s <= len(bounds)) & (F.get(table_, at + s - 1) <= x), at + s).otherwise(at),
    )
    return (found - 1).cast("int")


def placed_within(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Rows of a saved table with ``name``, their place from 0 within their group (not null) by the columns of ``order``.

    A sort in ranges of group, order and the row's place in its file: hot groups and hot keys are cut into ranges
    too. The sorted table is written, so that a row's number in its file and the counts of a group's earlier
    files give its place, and no window holds a group. Only among equal rows is the order left open.
    """
    by = [group, *order, "__row"]
    numbered_rows = rows.select("*", F.col("_metadata.row_index").alias("__row"))
    ranged = saved(numbered_rows.repartitionByRange(*by).sortWithinPartitions(*by))
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
    at = ranged.drop("__row").select("*", part.alias("__part"), F.col("_metadata.row_index").alias("__at"))
    runs = at.groupBy(group, "__part").agg(F.min("__at").alias("__low"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    placed = at.join(broadcast_if_small(saved(starts)), [group, "__part"])
    return placed.withColumn(name, F.col("__at") - F.col("__low") + F.col("__start")).select(*rows.columns, name)
