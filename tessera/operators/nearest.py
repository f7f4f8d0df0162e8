"""Exact nearest neighbours of a set of query vectors, block by block.

Vectors are packed into blocks of rows; every query block meets every data block once, as one matrix product
in a task, which keeps the best of its block for each query. Blocks meet by equal keys: a data block takes the
number of each query block in turn. Query blocks are broadcast if their vectors are few by count; else both
sides are dealt by query block and data bucket. Only the kept rows are shuffled after that. Rows joined grow
with (queries / block) * (rows / block), and a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lexical import top


#: Query vectors that are broadcast, at most: 128 MB of doubles at 256 dimensions.
MOST_BROADCAST = 1 << 16
BLOCK = "ids array<long>, matrix binary, width int"


def _block(part: pd.DataFrame) -> pd.DataFrame:
    """Vectors as one row: their ids, and a matrix of doubles with rows of unit length (zero rows stay)."""
    m = np.array(part["embedding"].tolist(), np.float64).reshape(len(part), -1)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    m = m / np.where(length == 0, 1, length)
    return pd.DataFrame({"ids": [part["id"].to_numpy(np.int64)], "matrix": [m.tobytes()], "width": [m.shape[1]]})


def packed_blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """ids, matrix, width: up to ``rows`` vectors of a partition in one row, all of one width."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                yield _block(pdf.iloc[at : at + rows])

    return vectors.where("embedding IS NOT NULL").select("id", "embedding").mapInPandas(run, BLOCK)


def query_blocks(queries: DataFrame, count: int) -> DataFrame:
    """k, ids, matrix, width: the vectors dealt by the hash of their ids into so many blocks."""
    run = lambda key, part: _block(part).assign(k=key[0])
    dealt = queries.where("embedding IS NOT NULL").select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("k"))
    return dealt.groupBy("k").applyInPandas(run, f"{BLOCK}, k int")


def neighbours(
    queries: DataFrame, vectors: DataFrame, limit: int, min_score: float | None = None, block: int = 1024, digits: int = 6
) -> DataFrame:
    """query_id, chunk_id, score, rank: the ``limit`` most similar vectors of each query.

    Score is the cosine, not below 0, rounded; ties by id. ``min_score`` drops weaker ones. Filters on
    vectors belong before the call, so that the best of those that pass are found. Vectors of another width
    than the queries' are an error; null ones are passed over.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                if r.width != r.q_width:
                    raise ValueError(f"a vector has {r.width} dimensions and a query {r.q_width}")
                q = np.frombuffer(r.q_matrix).reshape(-1, r.width)
                d = np.frombuffer(r.matrix).reshape(-1, r.width)
                ids = np.asarray(r.ids)
                score = np.round(np.maximum(q @ d.T, 0.0), digits)
                best = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :limit]
                found = np.take_along_axis(score, best, 1)
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(r.q_ids), best.shape[1]), "chunk_id": ids[best].ravel(), "score": found.ravel()})

    asked = queries.where("embedding IS NOT NULL").count()
    count = max(1, -(-asked // block))
    data = packed_blocks(vectors, block).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    sides = query_blocks(queries, count).select("k", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("width").alias("q_width"))
    if asked <= MOST_BROADCAST:
        met = data.join(F.broadcast(sides), "k")
    else:
        spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = data.withColumn("d", F.pmod(F.xxhash64("ids"), F.lit(spread)).cast("int"))
        met = dealt.join(sides.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).hint("merge"), ["k", "d"])
    found = met.select("ids", "matrix", "q_ids", "q_matrix", "width", "q_width").mapInPandas(run, "query_id long, chunk_id long, score double")
    if min_score is not None:
        found = found.where(F.col("score") >= min(max(min_score, 0.0), 1.0))
    return top(found, limit)
