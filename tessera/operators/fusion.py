"""Fusing ranked lists, blending a reranker's scores, and finishing results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, TOP_BONUS, NEXT_BONUS = 60, 0.05, 0.02
ORIGINAL_WEIGHT, EXPANDED_WEIGHT = 2.0, 1.0


@dataclass(frozen=True)
class RankedList:
    """query_id, chunk_id, score; lexical lists count as lists even where they are empty."""

    rows: DataFrame
    weight: float = ORIGINAL_WEIGHT
    counts_when_empty: bool = False


def fused(lists: list[RankedList]) -> DataFrame:
    """query_id, chunk_id, score: weighted reciprocal ranks with a bonus for leading places.

    Ties go to the earlier list, then the better rank in it (columns list_ord and first_rank). A query that
    has exactly one list keeps that list's raw scores.
    """
    all_ = reduce(
        DataFrame.unionByName,
        [
            part.rows.select("query_id", "chunk_id", "score", F.lit(i).alias("list_ord"), F.lit(part.weight).alias("weight"))
            for i, part in enumerate(lists)
        ],
    )
    place = Window.partitionBy("query_id", "list_ord").orderBy(F.col("score").desc(), "chunk_id")
    ranked = all_.withColumn("r", F.row_number().over(place) - 1)
    bonus = F.when(F.col("r") == 0, TOP_BONUS).when(F.col("r") <= 2, NEXT_BONUS).otherwise(0.0)
    merged = ranked.groupBy("query_id", "chunk_id").agg(
        (F.sum(F.col("weight") / (RRF_K + F.col("r") + 1)) + F.max(bonus)).alias("fused"),
        F.max("score").alias("raw"),
        F.min(F.struct("list_ord", "r")).alias("first"),
        F.collect_set("list_ord").alias("seen"),
    )
    standing = [i for i, part in enumerate(lists) if part.counts_when_empty]
    every = Window.partitionBy("query_id")
    lists_of = F.size(F.array_union(F.flatten(F.collect_set("seen").over(every)), F.array(*[F.lit(i) for i in standing]).cast("array<int>")))
    return merged.withColumn("n_lists", lists_of).select(
        "query_id", "chunk_id", F.when(F.col("n_lists") == 1, F.col("raw")).otherwise(F.col("fused")).alias("score"),
        F.col("first.list_ord").alias("list_ord"), F.col("first.r").alias("first_rank"), "n_lists",
    )


def ordered(fused_: DataFrame, limit: int) -> DataFrame:
    """The first rows of each query by score and the rules for ties; adds rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "list_ord", "first_rank", "chunk_id")
    return fused_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def candidates_for(limit: int) -> int:
    return max(4 * limit, 40)


def blended(candidates: DataFrame, reranked: DataFrame) -> DataFrame:
    """Candidates (query_id, chunk_id, score, rank) with a reranker's scores (query_id, chunk_id, rerank).

    Both sides are divided by their best; early candidates lean on fusion (3/4 to rank 3, 3/5 to rank 10,
    2/5 after). Candidates that the reranker leaves out vanish; with under two candidates, or no reranker
    rows for a query, the fused order stays.
    """
    every = Window.partitionBy("query_id")
    counted = candidates.withColumn("n", F.count(F.lit(1)).over(every)).withColumn("top", F.max("score").over(every))
    joined = counted.join(reranked, ["query_id", "chunk_id"], "left")
    joined = joined.withColumn("answered", F.count("rerank").over(every)).withColumn(
        "rerank_top", F.greatest(F.max("rerank").over(every), F.lit(1e-9))
    )
    share = F.when(F.col("rank") <= 3, 0.75).when(F.col("rank") <= 10, 0.6).otherwise(0.4)
    used = (F.col("n") >= 2) & (F.col("answered") > 0)
    mixed = share * F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0) + (1 - share) * F.col("rerank") / F.col("rerank_top")
    out = joined.where(~used | F.col("rerank").isNotNull()).select(
        "query_id", "chunk_id", F.when(used, mixed).otherwise(F.col("score")).alias("score"),
        F.when(used, F.col("rerank")).alias("rerank"), F.col("rank").alias("was"),
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rerank").desc_nulls_last(), "was")
    return out.withColumn("rank", F.row_number().over(order)).drop("was")


def finished(ranked: DataFrame, limit: int, min_result_score: float = 0.0) -> DataFrame:
    """Scores divided by the query's best, cut to ``limit``, then weak results dropped without refilling."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    share = F.when(F.col("best") > 0, F.least(F.lit(1.0), F.col("score") / F.col("best"))).otherwise(0.0)
    floor = min(max(min_result_score, 0.0), 1.0) if min_result_score == min_result_score else 0.0
    return (
        ranked.withColumn("best", best).where(F.col("rank") <= limit)
        .select("query_id", "rank", "chunk_id", share.alias("score")).where(F.col("score") >= floor)
    )
