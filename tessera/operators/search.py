"""Hybrid search for a batch of queries: one plan from index to finished results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.codecs import docid
from tessera.functions.han import Segmenter, bigrams
from tessera.functions.responses import with_marks
from tessera.functions.text import distinct_queries, phrases_of, snippet
from tessera.operators.fusion import (
    EXPANDED_WEIGHT, ORIGINAL_WEIGHT, RankedList, blended, candidates_for, finished, fused, ordered,
)
from tessera.operators.lexical import Inverted, bm25, top
from tessera.operators.nearest import neighbours
from tessera.operators.scratch import broadcast_if_small, saved


@dataclass(frozen=True)
class Options:
    mode: str = "hybrid"  # or bm25, vector
    limit: int = 10
    min_score: float = 0.3
    min_result_score: float = 0.01
    collections: tuple[str, ...] = ()
    #: How Han text is cut, as in the index.
    segmenter: Segmenter = bigrams
    #: Whether snippets mark what matched; else, and where nothing does, they are windows of the text.
    highlight: bool = True

    def phrases(self, text: Column) -> Column:
        return phrases_of(F.trim(text), self.segmenter(F.trim(text)))


@dataclass(frozen=True)
class Corpus:
    """chunks (chunk_id, doc_id, content, start_line, end_line), the index and vectors.

    title, path and collection are columns of ``documents`` (doc_id), so that contents needn't be joined with
    them but for the results, or of the chunks themselves where there is no such table.
    """

    chunks: DataFrame
    index: DataFrame | Inverted
    stats: DataFrame
    embeddings: DataFrame | None = None
    documents: DataFrame | None = None
    #: How rows with a chunk_id get columns of their chunks, where a stored index needn't read all of them for that.
    chunks_at: Callable[..., DataFrame] | None = None

    def chunks_in(self, collections: tuple[str, ...]) -> DataFrame:
        """chunk_id of the chunks of some collections."""
        inside = F.col("collection").isin(*collections)
        if self.documents is None:
            return self.chunks.where(inside).select("chunk_id")
        return self.chunks.select("chunk_id", "doc_id").join(self.documents.where(inside).select("doc_id"), "doc_id", "left_semi").select("chunk_id")

    def with_content(self, rows: DataFrame) -> DataFrame:
        """Rows with a chunk_id, and their chunks' content."""
        if self.chunks_at is not None:
            return self.chunks_at(rows, "content")
        return broadcast_if_small(rows).join(self.chunks.select("chunk_id", "content"), "chunk_id")

    def completed(self, results: DataFrame) -> DataFrame:
        """Results with their document's and chunk's columns; they are few and go to the tables, not these to them.

        Contents come last, so that what is broadcast stays slim.
        """
        if self.documents is None:
            return broadcast_if_small(results).join(self.chunks, "chunk_id")
        if self.chunks_at is not None:
            placed = results.withColumn("doc_id", F.shiftright("chunk_id", 20))
        else:
            placed = broadcast_if_small(results).join(self.chunks.select("chunk_id", "doc_id"), "chunk_id")
        owned = saved(broadcast_if_small(saved(placed)).join(self.documents.select("doc_id", "title", "path", "collection"), "doc_id"))
        if self.chunks_at is not None:
            return self.chunks_at(owned, "content", "start_line", "end_line")
        return broadcast_if_small(owned).join(self.chunks.drop("doc_id"), "chunk_id")


Reranker = Callable[[DataFrame], DataFrame]


def search(
    queries: DataFrame, corpus: Corpus, options: Options = Options(), reranked: DataFrame | Reranker | None = None, warnings: list[str] | None = None
) -> DataFrame:
    """Results for queries (query_id, query, and optionally expansions array<string>, embedding, hyde).

    ``expansion_embeddings`` (array<array<float>>, beside expansions) has the vectors of the expansions by place.
    Statistics are the whole corpus's; the filter by collection holds for results only. Only ids and scores
    travel through fusion; contents are joined to the final rows, and to the candidates (query_id, query, chunk_id,
    content, rank) that ``reranked``, if it is a function, gives scores (query_id, chunk_id, rerank).

    With ``warnings``, each list is made on its own: one that fails is left out and adds a line to them.
    """
    allowed = corpus.chunks_in(options.collections) if options.collections else None
    only = lambda rows: rows.join(allowed, "chunk_id", "left_semi") if allowed is not None else rows
    wide, lists = candidates_for(options.limit), []

    def add(name: str, make: Callable[[], DataFrame], weight: float, lexical: bool = False) -> DataFrame | None:
        """One list; its rows if it could be made."""
        if warnings is None:
            lists.append(RankedList(make(), weight, lexical))
            return lists[-1].rows
        try:
            rows = saved(make().select("query_id", "chunk_id", "score"))
        except Exception as e:  # noqa: BLE001  whatever keeps a list from being made costs that list alone
            warnings.append(f"{name} search failed: {str(e).strip().splitlines()[-1][:300]}")
            return None
        lists.append(RankedList(rows, weight, lexical))
        return rows

    def lexical_rows(asked: DataFrame) -> DataFrame:
        return top(only(bm25(asked, corpus.index, corpus.stats, None if options.collections else wide)), wide)

    if options.mode != "vector":
        add("lexical", lambda: lexical_rows(queries.select("query_id", options.phrases(F.col("query")).alias("phrases"))), ORIGINAL_WEIGHT, True)
        if options.mode == "hybrid" and "expansions" in queries.columns:
            more = queries.select("query_id", F.posexplode("expansions").alias("k", "text"), "query").where("text <> query")
            # each expansion is a list of its own: fused under a joint id, then told apart by place
            keyed = more.select(F.struct("query_id", "k").alias("query_id"), options.phrases(F.col("text")).alias("phrases"))
            most = more.agg(F.max("k")).first()[0]
            found = lexical_rows(keyed) if most is not None else None
            for k in range((most + 1) if most is not None else 0):
                add(f"lexical {k + 1}", lambda k=k: found.where(F.col("query_id.k") == k).withColumn("query_id", F.col("query_id.query_id")), EXPANDED_WEIGHT, True)
    if options.mode != "bm25" and corpus.embeddings is not None:
        vectors = only(corpus.embeddings).select(F.col("chunk_id").alias("id"), "embedding")
        near = lambda asked: neighbours(asked, vectors, wide, options.min_score)
        going = True
        if "embedding" in queries.columns:
            going = add("vector", lambda: near(queries.select(F.col("query_id").alias("id"), "embedding")), ORIGINAL_WEIGHT) is not None
        if going and {"expansions", "expansion_embeddings"} <= set(queries.columns):
            more = queries.select("query_id", "query", F.posexplode(F.arrays_zip("expansions", "expansion_embeddings")).alias("k", "e"))
            more = more.where("e.expansions <> query AND e.expansion_embeddings IS NOT NULL")
            most = more.agg(F.max("k")).first()[0]
            # each place is a pass of its own: a filter on a joint pass would be pushed below it, and all be done for each place
            for k in range((most + 1) if most is not None else 0):
                asked = more.where(F.col("k") == k).select(F.col("query_id").alias("id"), F.col("e.expansion_embeddings").alias("embedding"))
                if add(f"vector {k + 1}", lambda asked=asked: near(asked), EXPANDED_WEIGHT) is None:
                    break
        if "hyde" in queries.columns:
            add("answer", lambda: near(queries.select(F.col("query_id").alias("id"), F.col("hyde").alias("embedding"))), EXPANDED_WEIGHT)
    if not lists:
        lists.append(RankedList(queries.select("query_id", F.lit(0).cast("long").alias("chunk_id"), F.lit(0.0).alias("score")).where(F.lit(False))))
    ranked = ordered(fused(lists), wide)
    if reranked is not None:
        ranked = saved(ranked.select("query_id", "chunk_id", "score", "rank"))
        if callable(reranked):
            candidates = corpus.with_content(ranked.select("query_id", "chunk_id", "rank")).join(queries.select("query_id", "query"), "query_id")
            reranked = saved(reranked(candidates.select("query_id", "query", "chunk_id", "content", "rank")))
        ranked = blended(ranked, reranked)
    final = saved(finished(ranked, options.limit, options.min_result_score))
    shown = snippet(F.col("content"), F.col("query"))
    marked = options.highlight and options.mode != "vector"
    rows = (
        corpus.completed(final)
        .join(queries.select("query_id", "query"), "query_id")
        .select(
            "query_id", "rank", docid(F.col("doc_id")).alias("docid"), "chunk_id", F.col("path").alias("file"), "title", "collection",
            "score", shown.alias("snippet"), "start_line", "end_line", *(["content", options.phrases(F.col("query")).alias("phrases")] if marked else []),
        )
    )
    return with_marks(rows) if marked else rows


def warned(queries: DataFrame, warnings: list[str]) -> DataFrame:
    """query_id, warning: what each query of a batch is to be told; few, since lists are."""
    return queries.select("query_id", F.explode(F.array(*[F.lit(w) for w in warnings]).cast("array<string>")).alias("warning"))


def described(queries: DataFrame, options: Options = Options()) -> DataFrame:
    """What goes with the results: query_id, expanded_queries (all of them if there are several, else none), warnings.

    Missing vectors are worth a warning in vector mode alone; elsewhere the other lists stand in for them.
    """
    everything = distinct_queries(F.col("query"), F.col("expansions") if "expansions" in queries.columns and options.mode != "bm25" else F.array().cast("array<string>"))
    without = F.col("embedding").isNull() if "embedding" in queries.columns else F.lit(True)
    none = F.array().cast("array<string>")
    warned = F.when(without & F.lit(options.mode == "vector"), F.array(F.lit("no vector for the query: vector search is unavailable"))).otherwise(none)
    return queries.select("query_id", F.when(F.size(everything) > 1, everything).otherwise(none).alias("expanded_queries"), warned.alias("warnings"))
