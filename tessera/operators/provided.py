"""Search with a provider of models: vectors of queries, expansions, made-up answers, and reranking.

What the provider can't give is done without: no expansion, no vector list, or the fused order. Every answer is
written once, so that no retried or repeated plan asks again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import providers, responses
from tessera.functions.providers import Limits, Provider
from tessera.operators.scratch import saved
from tessera.operators.search import Corpus, Options, search


@dataclass(frozen=True)
class Asked:
    """What is asked of the provider; the prompts are followed by a colon, a space and the query."""

    expansions: bool = True
    hyde: bool = True
    rerank: bool = True
    expand_prompt: str = "expand"
    hyde_prompt: str = "answer"


def completed_queries(queries: DataFrame, provider: Provider, asked: Asked = Asked(), mode: str = "hybrid", limits: Limits = Limits()) -> DataFrame:
    """Queries (query_id, query) with expansions, embedding, expansion_embeddings and hyde, as ``search`` takes them.

    Expansions are the answer's alternatives, each once and without the query; lexical search alone asks for none.
    """
    prompt = lambda task: F.concat(F.lit(f"{task}: "), F.col("query")).alias("prompt")
    rows = queries.select("query_id", "query")
    none = F.array().cast("array<string>")
    texts = rows.select("query_id", F.lit("query").alias("kind"), F.lit(0).alias("k"), F.col("query").alias("text"))
    if asked.expansions and mode != "bm25":
        answers = saved(providers.completed(rows.select("query_id", "query", prompt(asked.expand_prompt)), provider, limits=limits))
        alternatives = F.filter(F.array_distinct(F.coalesce(responses.expansions(F.col("answer")), none)), lambda q: q != F.col("query"))
        rows = saved(answers.select("query_id", "query", alternatives.alias("expansions")))
        texts = texts.unionByName(rows.select("query_id", F.lit("expansion").alias("kind"), F.posexplode("expansions").alias("k", "text")))
    if mode == "bm25":
        return rows
    if asked.hyde:
        made = saved(providers.completed(queries.select("query_id", prompt(asked.hyde_prompt)), provider, limits=limits))
        texts = texts.unionByName(made.where("trim(answer) <> ''").select("query_id", F.lit("hyde").alias("kind"), F.lit(0).alias("k"), F.trim("answer").alias("text")))
    vectors = saved(providers.embedded(texts, provider, limits=limits))
    of = lambda kind: F.max_by("embedding", F.when(F.col("kind") == kind, 1))
    many = F.map_from_entries(F.collect_list(F.when((F.col("kind") == "expansion") & F.col("embedding").isNotNull(), F.struct("k", "embedding"))))
    by_query = vectors.groupBy("query_id").agg(of("query").alias("embedding"), of("hyde").alias("hyde"), many.alias("many"))
    out = rows.join(by_query, "query_id", "left")
    if "expansions" in rows.columns:
        out = out.withColumn("expansion_embeddings", F.transform("expansions", lambda _, i: F.element_at("many", i)))
    return saved(out.drop("many", *([] if asked.hyde else ["hyde"])))


def provided_search(
    queries: DataFrame, corpus: Corpus, provider: Provider, options: Options = Options(), asked: Asked = Asked(), limits: Limits = Limits(), warnings: list[str] | None = None
) -> DataFrame:
    """``search`` for queries (query_id, query) with all that the provider can give.

    A query whose vector can't be had has the other lists; in vector mode that is worth a warning.
    """
    rows = completed_queries(queries, provider, asked, options.mode, limits)
    if warnings is not None and options.mode == "vector":
        missing = rows.where("embedding IS NULL").count()
        if missing:
            warnings.append(f"no vector for {missing} queries: vector search is unavailable")
    rerank = partial(providers.reranked, provider=provider, limits=limits) if asked.rerank else None
    return search(rows, corpus, options, rerank, warnings)


def embedded_chunks(corpus: Corpus, provider: Provider, limits: Limits = Limits()) -> DataFrame:
    """chunk_id, embedding of a corpus's chunks, headings with them."""
    text = "embedding_content" if "embedding_content" in corpus.chunks.columns else "content"
    made = providers.embedded(corpus.chunks.select("chunk_id", F.col(text).alias("text")), provider, limits=limits)
    return made.where("embedding IS NOT NULL").select("chunk_id", "embedding")
