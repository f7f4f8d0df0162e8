"""Retrieval metrics over runs (query_id, doc_id, rank, score) and judgements (query_id, doc_id, relevance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_chunks(hits: DataFrame) -> DataFrame:
    """Hits by chunk (query_id, chunk_id, doc_id, score, chunk_rank) to documents, ranked.

    A document has its best chunk's score; ties go by that chunk's rank, then by document.
    """
    best = F.min(F.struct((-F.col("score")).alias("neg"), "chunk_rank", "chunk_id"))
    docs = hits.groupBy("query_id", "doc_id").agg(best.alias("b")).select(
        "query_id", "doc_id", (-F.col("b.neg")).alias("score"), F.col("b.chunk_id").alias("chunk_id"), F.col("b.chunk_rank").alias("chunk_rank")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_rank", "doc_id")
    return docs.withColumn("rank", F.row_number().over(order))


def _gain(relevance: Column) -> Column:
    return F.pow(F.lit(2.0), relevance) - 1


def per_query(run: DataFrame, judgements: DataFrame, k: int) -> DataFrame:
    """ndcg, recall, mrr, precision and hit at k for every judged query; unanswered ones score 0."""
    ideal = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "doc_id")
    wanted = (
        judgements.withColumn("place", F.row_number().over(ideal))
        .groupBy("query_id")
        .agg(
            F.sum(F.when(F.col("place") <= k, _gain(F.col("relevance")) / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("best"),
            F.count_if(F.col("relevance") > 0).alias("positives"),
        )
    )
    found = (
        run.where(F.col("rank") <= k)
        .join(judgements, ["query_id", "doc_id"], "left")
        .withColumn("relevance", F.coalesce("relevance", F.lit(0)))
        .groupBy("query_id")
        .agg(
            F.sum(_gain(F.col("relevance")) / F.log2(F.col("rank") + 1.0)).alias("dcg"),
            F.count_if(F.col("relevance") > 0).alias("hits"),
            F.count(F.lit(1)).alias("returned"),
            F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("first"),
        )
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return wanted.join(found, "query_id", "left").select(
        "query_id", "positives",
        ratio(F.coalesce("dcg", F.lit(0.0)), F.col("best")).alias("ndcg"),
        ratio(F.coalesce("hits", F.lit(0)), F.col("positives")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        ratio(F.coalesce("hits", F.lit(0)), F.least(F.lit(k), F.coalesce("returned", F.lit(0)))).alias("precision"),
        F.when(F.coalesce("hits", F.lit(0)) > 0, 1.0).otherwise(0.0).alias("hit"),
    )


def averaged(metrics: DataFrame, only_positive: bool) -> DataFrame:
    """Means over queries; those without a relevant document are left out or count as 0."""
    rows = metrics.where("positives > 0") if only_positive else metrics
    return rows.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(c).alias(c) for c in ("ndcg", "recall", "mrr", "precision", "hit")])


def trec_line(query: Column, doc: Column, rank: Column, score: Column, name: str) -> Column:
    return F.format_string(f"%s Q0 %s %d %.10f {name}", query.cast("string"), doc.cast("string"), rank, score)
