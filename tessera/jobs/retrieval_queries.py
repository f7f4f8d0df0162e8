"""Registered retrieval queries over the given tables; their SQL is in ``retrieval_sql``.

``documents.source`` is the collection and ``/{source}/{doc_id}.txt`` the path. Query texts come from
``benchmark``: its items grow with the data. Documents have no vectors and vectors no text; ``doc_id = vec_id``
pairs them by declaration only, and says nothing of relevance.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.functions.codecs import docid, docid_value
from tessera.functions.text import distinct_queries, snippet, title_of, tokens
from tessera.functions.vectors import l2_normalized, norm
from tessera.jobs.indexing import CHUNKS_OF_A_DOCUMENT, chunk_id
from tessera.jobs.retrieval_sql import ORACLE_SQL  # noqa: F401
from tessera.jobs.shared import documents, path_of, shared_index, table
from tessera.operators import catalog, evaluation, fusion, lexical, recall
from tessera.operators.chunking import chunked
from tessera.operators.nearest import neighbours
from tessera.operators.scratch import broadcast_if_small, new_path, saved
from tessera.operators.search import Corpus, Options, search
from tessera.streaming.cache import kept
from tessera.streaming.watch import debounced, latest_state, sent

Query = Callable[[SparkSession, str], DataFrame]
#: Seconds that a cached answer lives in the stream of ``cache_stream``.
CACHE_TTL = 86_400
QUERIES: dict[str, Query] = {}


def registered(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The forward index of all documents, one chunk each, written once, and the corpus statistics."""
    a = saved(lexical.analyzed(documents(spark, sf_dir), "doc_id", "text"))
    return a, lexical.statistics(a)



def indexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents with the lines that they are on."""
    return plain_chunks(spark, sf_dir).select(
        chunk_id(F.col("doc_id"), F.col("chunk_idx")).alias("chunk_id"), "doc_id", "content", "start_line", "end_line"
    )


def item_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("t"))


def phrase_queries(spark: SparkSession, sf_dir: str, *spans: tuple[int, int]) -> DataFrame:
    """Each benchmark item asks for phrases of its tokens, given as (first from 1, length)."""
    asked = F.filter(F.array(*[F.slice("t", a, n) for a, n in spans]), lambda p: F.size(p) > 0)
    return item_tokens(spark, sf_dir).select("query_id", asked.alias("phrases"))


def scored(spark: SparkSession, sf_dir: str, *spans: tuple[int, int]) -> DataFrame:
    """BM25 of the phrases; rounded, so that equal texts tie."""
    index, stats = indexed(spark, sf_dir)
    found = lexical.bm25(phrase_queries(spark, sf_dir, *spans), index, stats)
    return found.withColumn("score", F.round("score", 6))


def results(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@registered
def bm25_single_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(lexical.top(scored(spark, sf_dir, (2, 1)), 10))


@registered
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole item as one phrase, among the chunks of all documents, by the index that a session's queries share."""
    index = shared_index(spark, sf_dir)
    asked = item_tokens(spark, sf_dir).where(F.size("t") > 0).select("query_id", F.array("t").alias("phrases"))
    found = lexical.bm25(asked, index.inverted(), index.statistics(), digits=6)
    return lexical.top(found, 10).select(
        "query_id", "rank", F.shiftright("chunk_id", 20).alias("doc_id"), (F.col("chunk_id") % CHUNKS_OF_A_DOCUMENT).cast("int").alias("chunk_idx"), "score"
    )


@registered
def bm25_or_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(lexical.top(scored(spark, sf_dir, (1, 2), (5, 1)), 10))


@registered
def bm25_collection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three collections only; the statistics stay those of all."""
    some = documents(spark, sf_dir).where(F.col("source").isin("src1", "src3", "src5")).select(F.col("doc_id").alias("chunk_id"))
    return results(lexical.top(scored(spark, sf_dir, (2, 1)).join(some, "chunk_id", "left_semi"), 10))


@registered
def bm25_idf_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in at least half of the documents, each as a query: their weight is the least there is."""
    index, stats = indexed(spark, sf_dir)
    n = stats.first()["n"]
    common = saved(lexical.term_counts(index).where(F.col("df") * 2 >= n))
    asked = common.select(F.col("term").alias("query_id"), F.array(F.array("term")).alias("phrases"))
    found = lexical.bm25(asked, index, stats).withColumn("score", F.round("score", 10))
    return lexical.top(found, 10).select(F.col("query_id").alias("term"), "rank", F.col("chunk_id").alias("doc_id"), "score")


@registered
def fts_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lexical.analyzed(documents(spark, sf_dir), "doc_id", "text")
    return lexical.statistics(a).select("n", F.round("avgdl", 6).alias("avgdl"), "tokens")


@registered
def postings_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and corpus frequency of every term."""
    return lexical.term_counts(lexical.analyzed(documents(spark, sf_dir), "doc_id", "text"))


@registered
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = documents(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"), F.lit(False).alias("markdown")))


@registered
def chunk_plain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_chunks(spark, sf_dir).select("doc_id", "chunk_idx", "start_line", "end_line", "token_count", F.md5("content").alias("content_md5"))


@registered
def chunk_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_chunks(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("tokens"))


@registered
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest start of each chunk, of 600 characters at most, that ends the one before."""
    w = Window.partitionBy("doc_id").orderBy("chunk_idx")
    pairs = plain_chunks(spark, sf_dir).withColumn("before", F.lag("content").over(w)).where("before IS NOT NULL")
    fits = F.filter(F.sequence(F.lit(600), F.lit(1)), lambda n: F.endswith("before", F.substring(F.col("content"), F.lit(1), n)))
    return pairs.select("doc_id", "chunk_idx", F.coalesce(F.get(fits, 0), F.lit(0)).alias("repeated"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 is a query."""
    return vectors(spark, sf_dir).where(F.col("id") % 20 == 0)


def near(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", F.col("chunk_id").alias("vec_id"), "score")


@registered
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(neighbours(asked_vectors(spark, sf_dir), vectors(spark, sf_dir), 5))


@registered
def knn_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(neighbours(asked_vectors(spark, sf_dir), vectors(spark, sf_dir), 10, 0.3))


@registered
def knn_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best among vectors of two labels: the filter comes before the choice."""
    return near(neighbours(asked_vectors(spark, sf_dir), vectors(spark, sf_dir).where("label IN (1, 3)"), 5))


@registered
def knn_batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query, how the labels of its 10 nearest agree with its own."""
    found = neighbours(asked_vectors(spark, sf_dir), vectors(spark, sf_dir), 10)
    label = vectors(spark, sf_dir).select(F.col("id").alias("chunk_id"), "label")
    own = vectors(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("label").alias("own"))
    return found.join(label, "chunk_id").join(own, "query_id").groupBy("query_id").agg(
        F.count_if(F.col("label") == F.col("own")).alias("same_label"), F.round(F.avg("score"), 5).alias("mean_score")
    )


@registered
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("length", norm(F.col("embedding")))
    unit = l2_normalized(F.col("embedding"), F.col("length"))
    return v.select(F.col("id").alias("vec_id"), F.round("length", 4).alias("length"), F.round(F.element_at(unit, 1), 4).alias("first"), F.round(F.element_at(unit, -1), 4).alias("last"))


def vector_list(spark: SparkSession, sf_dir: str, least: float | None = None) -> DataFrame:
    """Neighbours of the vector that bears a benchmark item's id, among all."""
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    return neighbours(vectors(spark, sf_dir).join(ids, "id", "left_semi"), vectors(spark, sf_dir), 40, least).drop("rank")


def lexical_list(spark: SparkSession, sf_dir: str, *spans: tuple[int, int]) -> DataFrame:
    return lexical.top(scored(spark, sf_dir, *spans), 40).drop("rank")


def fused_rows(found: DataFrame, limit: int = 10) -> DataFrame:
    return results(fusion.ordered(found, limit))


@registered
def rrf_two_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [fusion.RankedList(lexical_list(spark, sf_dir, (2, 1)), counts_when_empty=True), fusion.RankedList(vector_list(spark, sf_dir))]
    return fused_rows(fusion.fused(lists))


@registered
def rrf_weighted_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original phrase weighs 2, an expansion 1, the vector 2."""
    lists = [
        fusion.RankedList(lexical_list(spark, sf_dir, (1, 2)), counts_when_empty=True),
        fusion.RankedList(lexical_list(spark, sf_dir, (5, 1)), fusion.EXPANDED_WEIGHT, True),
        fusion.RankedList(vector_list(spark, sf_dir, 0.3)),
    ]
    return fused_rows(fusion.fused(lists))


@registered
def rrf_single_list_fast_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list alone keeps its scores."""
    return fused_rows(fusion.fused([fusion.RankedList(vector_list(spark, sf_dir, 0.3))]))


@registered
def rrf_empty_bm25_plus_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexical list without a hit still counts, so that ranks and not scores are fused."""
    none = scored(spark, sf_dir, (1, 60)).where("score < 0")
    return fused_rows(fusion.fused([fusion.RankedList(none, counts_when_empty=True), fusion.RankedList(vector_list(spark, sf_dir, 0.3))]))


@registered
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine: phrase and vector lists of each whole item, fused, finished, with chunks joined.

    A document's vector is declared to be its first chunk's. Items without a vector have the lexical list alone.
    """
    index = shared_index(spark, sf_dir)
    embedded = vectors(spark, sf_dir).select(F.col("id").alias("query_id"), "embedding")
    data = embedded.select((F.col("query_id") * CHUNKS_OF_A_DOCUMENT).alias("chunk_id"), "embedding").join(index.chunks.select("chunk_id"), "chunk_id", "left_semi")
    asked = item_tokens(spark, sf_dir).select("query_id", F.array_join("t", " ").alias("query")).join(embedded, "query_id", "left")
    found = search(asked, index.corpus(data), Options(min_score=0.3, min_result_score=0.01, highlight=False))
    return found.select("query_id", "rank", "docid", "file", "collection", F.round("score", 6).alias("score"), "start_line", "end_line")


def reranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused candidates with a stand-in reranker: a score by id, some left out."""
    lists = [fusion.RankedList(lexical_list(spark, sf_dir, (2, 1)), counts_when_empty=True), fusion.RankedList(vector_list(spark, sf_dir))]
    ranked = saved(fusion.ordered(fusion.fused(lists), 40).select("query_id", "chunk_id", "score", "rank"))
    scores = ranked.where("chunk_id % 5 <> 0").select("query_id", "chunk_id", (1.0 / (1 + F.col("chunk_id") % 7)).alias("rerank"))
    return fusion.blended(ranked, scores)


@registered
def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reranked_candidates(spark, sf_dir)
    return rows.where("rank <= 10").select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), F.round("rerank", 6).alias("rerank"))


@registered
def normalize_min_result_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over the best, ten at most, of which weak ones go without refilling."""
    return results(fusion.finished(lexical.top(scored(spark, sf_dir, (1, 1), (2, 1)), 40), 10, 0.8))


@registered
def snippet_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of each document around the first of two words."""
    d = documents(spark, sf_dir)
    query = F.concat_ws(" ", F.lit("x"), F.try_element_at(F.split("text", r"[ \n]+"), F.lit(-2)), F.lit("the"))
    return d.where("length(text) > 0").select("doc_id", snippet(F.col("text"), query).alias("snippet"))


@registered
def docid_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", docid(F.col("doc_id") * 4099).alias("docid"))
    return d.select("doc_id", "docid", docid_value(F.col("docid")).alias("back"))


@registered
def sha1_change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by content hash: how many share it, and the first."""
    return documents(spark, sf_dir).groupBy(F.sha1("text").alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


def stored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index might have stored before: some documents missing, older, different or since gone."""
    d = documents(spark, sf_dir)
    hash_ = F.when(F.col("doc_id") % 5 == 0, F.sha1(F.concat("text", F.lit("!")))).otherwise(F.sha1("text"))
    mtime = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") - 1).otherwise(F.col("n_chars")).cast("double")
    old = d.where("doc_id % 7 <> 0").select(F.col("source").alias("collection"), path_of().alias("path"), mtime.alias("mtime"), hash_.alias("hash"))
    gone = d.where("doc_id % 11 = 0").select(F.lit("gone").alias("collection"), path_of().alias("path"), F.lit(1.0).alias("mtime"), F.sha1("text").alias("hash"))
    return old.unionByName(gone)


def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("source").alias("collection"), path_of().alias("path"), F.col("n_chars").cast("double").alias("mtime"), F.sha1("text").alias("hash"))


@registered
def change_status_four_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.change_status(current_state(spark, sf_dir), stored_state(spark, sf_dir), "collection", "path")


@registered
def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document is given a heading; the others are called after their files."""
    d = documents(spark, sf_dir)
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("intro\n## Part "), F.col("doc_id").cast("string"), F.lit("\n"), "text")).otherwise(F.col("text"))
    return d.select("doc_id", title_of(content, path_of()).alias("title"))


def catalog_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.col("source").alias("collection"), F.col("n_chars").alias("indexed_at"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that aren't blank, as chunks."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return documents(spark, sf_dir).select("doc_id", F.posexplode(lines).alias("chunk_idx", "content"))


@registered
def collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog_documents(spark, sf_dir)
    return catalog.collection_status(docs.select(F.col("collection").alias("name")).distinct(), docs, document_chunks(spark, sf_dir))


@registered
def collection_stats_empty_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections named after languages exist too, and hold nothing."""
    docs = catalog_documents(spark, sf_dir)
    names = docs.select(F.col("collection").alias("name")).union(documents(spark, sf_dir).select(F.concat(F.lit("empty-"), "lang"))).distinct()
    return catalog.collection_status(names, docs, document_chunks(spark, sf_dir))


@registered
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed documents keep their ids, new ones get the next."""
    d = documents(spark, sf_dir).select(F.col("source").alias("collection"), path_of().alias("path"), "n_chars", "doc_id")
    stored = d.where("doc_id % 4 <> 0").select("collection", "path", "doc_id", F.col("n_chars").alias("size"), F.lit(0).alias("created_at"))
    changes = d.where("doc_id % 2 = 0").select("collection", "path", (F.col("n_chars") + 1).alias("size"), F.lit(9).alias("created_at"))
    return catalog.upserted(stored, changes, ["collection", "path"], "doc_id", ["created_at"]).select("collection", "path", "doc_id", "size", "created_at")


@registered
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left by table after one collection's documents are deleted."""
    docs = catalog_documents(spark, sf_dir)
    tables = {"documents": docs, "chunks": document_chunks(spark, sf_dir), "embeddings": table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")}
    left = catalog.cascade_deleted(tables, docs.where("collection = 'src1'"))
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kept_in"), "n") for name, t in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a time without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cached responses: the user and type are the key."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("cache_key"), F.col("event_id").alias("response"),
        F.floor(micros("ts") / 1_000_000).alias("created_at"), F.lit(86400).alias("ttl_sec"),
    )


def now(rows: DataFrame) -> Column:
    return F.lit(rows.agg(F.max("created_at").alias("t")).first()["t"])


@registered
def llm_cache_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cache(spark, sf_dir)
    return catalog.latest(rows).where(catalog.alive(now(rows))).select("cache_key", "response", "created_at")


@registered
def llm_cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries the eviction removes, by type of event."""
    rows = cache(spark, sf_dir)
    kind = F.substring_index("cache_key", ":", 1)
    return catalog.latest(rows).groupBy(kind.alias("kind")).agg(F.count_if(~catalog.alive(now(rows))).alias("evicted"), F.count(F.lit(1)).alias("entries"))


@registered
def query_expansion_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's first words, then its lines and first words again: each once, in order."""
    b = table(spark, sf_dir, "benchmark")
    first = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    more = F.concat(F.split("text", "\n"), F.array(first), F.split("text", "\n"))
    rows = b.select("item_id", distinct_queries(first, more).alias("queries"))
    return rows.select("item_id", F.posexplode("queries").alias("position", "query"))


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of BM25 over lines as chunks, with their places and the documents they belong to."""
    chunks = document_chunks(spark, sf_dir).withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_idx")))
    a = saved(lexical.analyzed(chunks))
    found = lexical.bm25(phrase_queries(spark, sf_dir, (2, 1)), a, lexical.statistics(a)).withColumn("score", F.round("score", 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))
    return found.select("query_id", "chunk_id", F.shiftright("chunk_id", 20).alias("doc_id"), "score", place.alias("chunk_rank"))


@registered
def doc_collapse_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = evaluation.best_chunks(line_hits(spark, sf_dir))
    return best.where("rank <= 10").select("query_id", "rank", "doc_id", "score", "chunk_id", "chunk_rank")


@registered
def files_distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collections of a query's hits, each at its first rank."""
    owner = documents(spark, sf_dir).select("doc_id", "source")
    # a document's first line stands for it before the documents are met
    first = line_hits(spark, sf_dir).groupBy("query_id", "doc_id").agg(F.min("chunk_rank").alias("rank"))
    return catalog.distinct_files(first.join(owner, "doc_id").select("query_id", F.col("source").alias("file"), "rank"))


def run_and_judgements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs for the items' second tokens; labelled documents count as judged for every query by quality and id."""
    run = bm25_single_term(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    some = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    # each labelled document is judged for the items of its remainder only, so that judgements grow with labels
    n = some.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    judged = labels.select(
        F.explode(F.array((F.col("doc_id") % max(n, 1)), (F.col("doc_id") % 7), F.lit(0))).alias("query_id"), "doc_id",
        (F.col("quality") * (1 + F.col("doc_id") % 2)).cast("int").alias("relevance"),
    ).distinct()
    return run, judged.join(some, "query_id", "left_semi")


@registered
def eval_ndcg_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.per_query(*run_and_judgements(spark, sf_dir), k=10)
    return m.select("query_id", F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"))


@registered
def eval_mrr_p_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over queries, without and with those that have no relevant document."""
    m = evaluation.per_query(*run_and_judgements(spark, sf_dir), k=10)
    rounded = lambda d, name: d.select(F.lit(name).alias("averaged"), "queries", *[F.round(c, 6).alias(c) for c in ("mrr", "precision", "hit")])
    return rounded(evaluation.averaged(m, True), "positive").unionByName(rounded(evaluation.averaged(m, False), "all"))


@registered
def trec_run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = bm25_single_term(spark, sf_dir)
    return run.select(evaluation.trec_line(F.col("query_id"), F.col("doc_id"), F.col("rank"), F.col("score"), "tessera").alias("line"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations on their whole texts."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("prompt"))


@registered
def recall_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("conv_id", "turn", recall.decision(F.col("prompt"), F.col("role")).alias("reason"))


@registered
def recall_query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("conv_id", "turn", recall.query_for(F.col("prompt")).alias("query"))


def recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected notes of each item: the best line of a document stands for it before documents are met; no content travels."""
    owner = documents(spark, sf_dir).select("doc_id", F.col("source").alias("collection"), path_of().alias("path"))
    hits = line_hits(spark, sf_dir)
    best = hits.groupBy("query_id", "doc_id").agg(F.min_by(F.struct("chunk_id", "score", "chunk_rank"), "chunk_rank").alias("b")).select("query_id", "doc_id", "b.*")
    shared = F.max("score").over(Window.partitionBy("query_id"))
    rows = best.withColumn("score", F.round(F.col("score") / shared, 2)).join(owner, "doc_id")
    return recall.selected(rows.select("query_id", "path", "collection", "chunk_id", "score", F.col("chunk_rank").alias("rank")))


@registered
def recall_select_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recalled(spark, sf_dir).select("query_id", "rank", "path", "score")


@registered
def recall_context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context that fits in 600 characters, and how many notes it holds; the few notes go to the lines, and not these to them."""
    lines = document_chunks(spark, sf_dir).select(chunk_id(F.col("doc_id"), F.col("chunk_idx")).alias("chunk_id"), "content")
    chosen = broadcast_if_small(saved(recalled(spark, sf_dir))).join(lines, "chunk_id")
    made = recall.context(chosen.withColumn("title", F.lit(None).cast("string")), 600)
    return made.select("query_id", "injected", F.length("context").alias("n_chars"))


@registered
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages' paths the ignore rules leave out."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://(.*)", 1).alias("path"))
    out = catalog.ignored(F.col("path"), ["*.html", "en", "blog.tionsh.example.com"])
    return p.select("page_id", out.alias("ignored"), catalog.indexable(F.col("path")).alias("indexable"))


def change_columns() -> list[Column]:
    op = F.when(F.col("event_type") == "error", "unlink").otherwise("change")
    return [F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), op.alias("op")]


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*change_columns(), "ts")


@registered
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of changes that an hour of quiet ends."""
    b = debounced(change_events(spark, sf_dir), "1 hour")
    return b.select("path", micros("opened").alias("opened"), micros("closed").alias("closed"), "op", "changes")


def in_turns(spark: SparkSession, rows: DataFrame, turns: int, last: DataFrame, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Rows with a time ``ts`` as a stream that is taken up again for each of so many stretches of time, and for ``last``.

    ``run`` starts a query over the rows written so far, from its checkpoint, that ends when it has taken them.
    """
    at = new_path(spark)
    ends = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    low, high = ends["low"], ends["high"]
    stretch = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(low))) * turns / F.greatest(F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)), F.lit(1))), F.lit(turns - 1))
    cut = saved(rows.withColumn("__turn", stretch))
    for turn in range(turns + 1):
        (cut.where(F.col("__turn") == turn).drop("__turn") if turn < turns else last).write.mode("append").parquet(at)
        run(spark.readStream.schema(rows.schema).parquet(at)).awaitTermination()


@registered
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each path after a stream of all changes in several turns: a burst comes once, when the watermark has passed it, and is put into the state.

    The state of a burst is kept no longer than that. A last event, a week later, lets the bursts before it come.
    """
    at, version = new_path(spark), [0]
    changes = table(spark, sf_dir, "events").select(*change_columns(), F.col("ts").cast("timestamp").alias("ts"))
    end = changes.agg((F.max("ts") + F.expr("INTERVAL 7 DAYS")).alias("ts")).select(F.lit("/end").alias("path"), F.lit("change").alias("op"), "ts")

    def put(bursts: DataFrame, _: int) -> None:
        before = [spark.read.parquet(f"{at}/state{version[0]}")] if version[0] else []
        known = bursts.select("path", "op", "closed")
        latest_state(reduce(DataFrame.unionByName, before, known)).write.parquet(f"{at}/state{version[0] + 1}")
        version[0] += 1

    in_turns(spark, changes, 4, end, lambda rows: sent(rows, put, f"{at}/checkpoint", "1 hour", late="10 minutes"))
    state = spark.read.parquet(f"{at}/state{version[0]}")
    return state.select("path", "op", F.unix_micros("closed").alias("closed"))


@registered
def cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached answers on a stream in several turns: what became of each key's last answer, kept or expired by the time that has passed."""
    at = new_path(spark)
    e = table(spark, sf_dir, "events")
    answers = e.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("cache_key"), F.col("event_id").cast("string").alias("response"), F.col("ts").cast("timestamp").alias("ts"))

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{at}/events/part{batch:06d}")

    def run(rows: DataFrame) -> StreamingQuery:
        made = kept(rows, CACHE_TTL, "10 minutes").writeStream.outputMode("append").foreachBatch(keep)
        return made.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()

    in_turns(spark, answers, 4, answers.limit(0), run)
    events = spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/events")
    of_batch = events.select("cache_key", "batch", (F.col("event") == "put").alias("put"), F.col("response").cast("long").alias("response"))  # a key has one row in a batch
    last = of_batch.groupBy("cache_key").agg(F.max_by("put", "batch").alias("put"), F.max_by("response", "batch").alias("response"))
    return last.select("cache_key", F.when(F.col("put"), "put").otherwise("expired").alias("event"), "response")
