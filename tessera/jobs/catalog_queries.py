"""Registered queries of the catalog, of providers, recall, benchmark tables and Han search, each with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import codecs, providers, responses
from tessera.functions.text import phrases_of
from tessera.jobs import retrieval_queries as rq
from tessera.jobs.retrieval_queries import Query, document_chunks
from tessera.jobs.retrieval_sql import _INDEX, _ITEM_VECTORS, _PATH, _SCORED, _VECTORS, _WHOLE, _FUSE, _FUSED_OUT, _list, _near, _tokens, _top, _bm25
from tessera.jobs.shared import documents, path_of, shared_index, table
from tessera.operators import catalog, fusion, lexical, recall
from tessera.operators.chunking import chunked
from tessera.operators.nearest import neighbours
from tessera.operators.scratch import new_path, saved
from tessera.operators.search import Corpus, Options, described, search
from tessera.sources import benchmarks
from tessera.sources.files import files
from tessera.streaming.watch import applied, latest_state, owner

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# --- collections and documents -------------------------------------------------------------------


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as registered collections: name, path, pattern, created_at."""
    return documents(spark, sf_dir).groupBy(F.col("source").alias("name")).agg(
        F.concat(F.lit("/"), F.col("source")).alias("path"), F.lit("*.txt").alias("pattern"), F.min("n_chars").alias("created_at")
    )


_REGISTRY = "registry AS (SELECT source AS name, '/' || source AS path, '*.txt' AS pattern, min(n_chars) AS created_at FROM documents GROUP BY source)"


@registered(
    f"WITH {_REGISTRY}, changes AS (SELECT name, path || '/new' AS path, '*.md' AS pattern, 7 AS created_at FROM registry WHERE suffix(name, '1') "
    "UNION ALL SELECT DISTINCT lang, '/' || lang, '*.md', 7 FROM documents) "
    "SELECT c.name, c.path, c.pattern, coalesce(r.created_at, c.created_at) AS created_at FROM changes c LEFT JOIN registry r USING (name) "
    "UNION ALL SELECT * FROM registry WHERE name NOT IN (SELECT name FROM changes)"
)
def collections_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registering known and new collections: path and pattern change, the time of creation stays."""
    old = registry(spark, sf_dir)
    again = old.where(F.endswith("name", F.lit("1"))).select("name", F.concat("path", F.lit("/new")).alias("path"))
    new = documents(spark, sf_dir).select(F.col("lang").alias("name"), F.concat(F.lit("/"), "lang").alias("path")).distinct()
    changes = again.unionByName(new).select("*", F.lit("*.md").alias("pattern"), F.lit(7).cast("long").alias("created_at"))
    return catalog.put(old, changes, ["name"], ["created_at"])


def catalog_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = documents(spark, sf_dir).select("doc_id", F.col("source").alias("collection"), path_of().alias("path"))
    embeddings = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return {"documents": docs, "chunks": document_chunks(spark, sf_dir), "embeddings": embeddings}


def row_counts(tables: dict[str, DataFrame], **columns: Column) -> DataFrame:
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kept_in"), "n", *[c.alias(k) for k, c in columns.items()]) for name, t in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_LINE_COUNTS = "lines AS (SELECT doc_id, source, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS k FROM documents)"


@registered(
    f"WITH {_LINE_COUNTS}, gone AS (SELECT doc_id FROM documents WHERE source = 'src2') "
    "SELECT 'documents' AS kept_in, count(*) AS n, true AS existed, (SELECT count(DISTINCT source) FROM documents WHERE source <> 'src2') AS collections FROM documents WHERE doc_id NOT IN (FROM gone) "
    "UNION ALL SELECT 'chunks', CAST(sum(k) AS BIGINT), true, (SELECT count(DISTINCT source) FROM documents WHERE source <> 'src2') FROM lines WHERE doc_id NOT IN (FROM gone) "
    "UNION ALL SELECT 'embeddings', count(*), true, (SELECT count(DISTINCT source) FROM documents WHERE source <> 'src2') FROM embeddings WHERE vec_id NOT IN (FROM gone)"
)
def collection_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left by table when a collection goes with all it has, whether it was there, and the collections left."""
    left, tables, existed = catalog.collection_removed(registry(spark, sf_dir), catalog_tables(spark, sf_dir), "src2")
    return row_counts(tables, existed=F.lit(existed), collections=F.lit(left.count()))


@registered(
    f"WITH {_LINE_COUNTS} SELECT 'documents' AS kept_in, count(*) AS n FROM documents WHERE doc_id % 9 <> 0 "
    "UNION ALL SELECT 'chunks', CAST(sum(k) AS BIGINT) FROM lines WHERE doc_id % 9 <> 0 "
    "UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id % 9 <> 0 OR vec_id NOT IN (SELECT doc_id FROM documents)"
)
def delete_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left by table after documents are deleted by path; paths that nothing has change nothing."""
    tables = catalog_tables(spark, sf_dir)
    known = tables["documents"].where("doc_id % 9 = 0").select("collection", "path")
    missing = tables["documents"].select("collection", F.concat("path", F.lit(".missing")).alias("path"))
    return row_counts(catalog.documents_deleted(tables, known.unionByName(missing)))


@registered(
    "WITH cur AS (SELECT DISTINCT source AS name FROM documents WHERE doc_id % 3 = 0 UNION SELECT DISTINCT lang FROM documents), "
    "seen AS (SELECT DISTINCT source AS name FROM documents) "
    "SELECT name, 'collection_added' AS event FROM cur WHERE name NOT IN (SELECT name FROM seen) UNION ALL "
    "SELECT name, 'collection_removed' FROM seen WHERE name NOT IN (SELECT name FROM cur)"
)
def collections_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which collections came or went between two states of the registry."""
    d = documents(spark, sf_dir)
    current = d.where("doc_id % 3 = 0").select(F.col("source").alias("name")).union(d.select("lang")).distinct()
    return catalog.collections_changed(current, d.select(F.col("source").alias("name")).distinct())


@registered(
    "WITH puts AS (SELECT event_type AS key, event_id % 10 AS k, CAST(event_id AS VARCHAR) AS value, row_number() OVER (PARTITION BY event_type, event_id % 10 ORDER BY event_id) AS n FROM events), "
    "named AS (SELECT key || k AS key, value, n FROM puts) "
    "SELECT key, arg_max(value, n) AS value FROM named GROUP BY key"
)
def meta_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values: each put replaces the one before it, the last ones those stored earlier."""
    e = table(spark, sf_dir, "events")
    named = e.select(F.concat("event_type", (F.col("event_id") % 10).cast("string")).alias("key"), F.col("event_id").cast("string").alias("value"), "event_id")
    nth = lambda by: F.max_by("value", by).alias("value")
    first = named.groupBy("key").agg(nth(-F.col("event_id")))
    last = named.groupBy("key").agg(nth(F.col("event_id")))
    return catalog.put(first, last, ["key"])


@registered(
    f"WITH {_LINE_COUNTS} SELECT (SELECT count(*) FROM documents) AS documents, CAST((SELECT sum(k) FROM lines) AS BIGINT) AS chunks, (SELECT count(*) FROM embeddings) AS embedded"
)
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = catalog_tables(spark, sf_dir)
    return catalog.totals(tables["documents"], tables["chunks"], tables["embeddings"])


@registered(
    "SELECT count(*) FILTER (doc_id % 7 = 0 OR doc_id % 3 = 0) AS indexed, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 3 <> 0) AS skipped, 0 AS errors FROM documents"
)
def index_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An indexing run's counts: files that are new, changed or have another time, and those left as they were."""
    return catalog.run_counters(rq.change_status_four_way(spark, sf_dir))


# --- watching ------------------------------------------------------------------------------------


@registered(
    "WITH p AS (SELECT doc_id, '/' || source || CASE doc_id % 3 WHEN 0 THEN '/' WHEN 1 THEN 'x/' ELSE '/sub/' END || doc_id || '.txt' AS path FROM documents) "
    "SELECT doc_id, CASE WHEN starts_with(path, '/src1/sub/') THEN 'inner' WHEN starts_with(path, '/src1/') THEN 'one' WHEN starts_with(path, '/src10/') THEN 'ten' END AS collection, "
    "CASE WHEN starts_with(path, '/src1/') THEN substr(path, 7) ELSE path END AS relative FROM p"
)
def path_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path's collection, by the first root that is a folder above it, and the path below one root."""
    middle = F.when(F.col("doc_id") % 3 == 0, "/").when(F.col("doc_id") % 3 == 1, "x/").otherwise("/sub/")
    path = F.concat(F.lit("/"), "source", middle, F.col("doc_id").cast("string"), F.lit(".txt"))
    roots = [("inner", "/src1/sub"), ("one", "/src1/"), ("ten", "/src10")]
    return documents(spark, sf_dir).select("doc_id", owner(path, roots).alias("collection"), codecs.relative_path(path, F.lit("/src1")).alias("relative"))


@registered(
    "WITH ev AS (SELECT '/u/' || user_id AS path, arg_max(CASE WHEN event_type = 'error' THEN 'unlink' ELSE 'change' END, (ts, CASE WHEN event_type = 'error' THEN 'unlink' ELSE 'change' END)) AS op "
    "FROM events WHERE user_id % 2 = 0 GROUP BY user_id) "
    "SELECT DISTINCT '/u/' || user_id AS path, CASE WHEN user_id % 2 = 0 THEN 'read anew' ELSE 'stored' END AS content FROM events "
    "WHERE '/u/' || user_id NOT IN (SELECT path FROM ev WHERE op = 'unlink')"
)
def unlink_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored files after a batch of changes: those whose last change is an unlink are gone, changed ones are read anew."""
    events = rq.change_events(spark, sf_dir)
    even = table(spark, sf_dir, "events").where("user_id % 2 = 0").select(*rq.change_columns(), F.col("ts").alias("closed"))
    stored = events.select("path", F.lit("stored").alias("content")).distinct()
    return applied(stored, latest_state(even), lambda paths: paths.select("path", F.lit("read anew").alias("content")))


# --- chunks under headings -----------------------------------------------------------------------


@registered(
    "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL), "
    "h AS (SELECT doc_id, i, 1 + i % 3 AS level, 'H' || i AS name FROM l), "
    "p AS (SELECT *, max(CASE WHEN level = 1 THEN i END) OVER w AS a, max(CASE WHEN level = 2 THEN i END) OVER w AS b, max(CASE WHEN level = 3 THEN i END) OVER w AS c "
    "FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)) "
    "SELECT doc_id, count(*) AS sections, CAST(sum(2 * i + 1) AS BIGINT) AS first_lines, "
    "md5(string_agg('# H' || a || CASE WHEN b > a THEN ' > ## H' || b ELSE '' END || CASE WHEN c > b AND b > a THEN ' > ### H' || c ELSE '' END, chr(10) ORDER BY i)) AS paths FROM p GROUP BY doc_id"
)
def markdown_heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a heading of level 1, 2, 3, 1 ... put above each line: the heading path and first line of every section."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.repeat(F.lit("#"), (i % 3 + 1).cast("int")), F.lit(" H"), i.cast("string"), F.lit("\n"), x))
    chunks = chunked(documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.array_join(lines, "\n").alias("content"), F.lit(True).alias("markdown")))
    # a section longer than a chunk gives several with the same path, of which the first counts
    heading = F.split(F.regexp_extract("heading_path", r"H(\d+)$", 1), ",")[0].cast("int")
    sections = chunks.withColumn("i", heading).groupBy("doc_id", "i").agg(F.min("start_line").alias("line"), F.first("heading_path").alias("path"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "path"))), lambda s: s["path"])
    return sections.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sections"), F.sum("line").cast("long").alias("first_lines"), F.md5(F.array_join(ordered, "\n")).alias("paths")
    )


# --- providers -----------------------------------------------------------------------------------

_LETTERS = "etaoinsr"


@registered(
    "WITH c AS (SELECT doc_id, [CAST(length(lower(text)) - length(replace(lower(text), l, '')) AS DOUBLE) FOR l IN ['e', 't', 'a', 'o', 'i', 'n', 's', 'r']] AS v FROM documents WHERE length(text) > 0) "
    "SELECT doc_id, round(v[1] / n, 4) AS first, round(v[8] / n, 4) AS last FROM (SELECT doc_id, v, CASE WHEN list_inner_product(v, v) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END AS n FROM c)"
)
def provider_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of all texts, asked for in batches of a stand-in provider that answers in another order."""
    rows = documents(spark, sf_dir).where("length(text) > 0").select("doc_id", "text")
    made = providers.embedded(rows, providers.LetterProvider(_LETTERS))
    return made.select("doc_id", F.round(F.element_at("embedding", 1).cast("double"), 4).alias("first"), F.round(F.element_at("embedding", -1).cast("double"), 4).alias("last"))


@registered(
    "WITH a AS (SELECT conv_id, turn, length(text) AS n FROM conversations) SELECT conv_id, array_to_string(list(n ORDER BY turn), ',') AS lengths FROM a GROUP BY conv_id"
)
def answers_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that come in any order, put back in the order of what was asked."""
    answer = F.struct(F.col("turn").alias("index"), F.length("text").alias("embedding"))
    asked = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(answer), asc=False).alias("answers"))
    return asked.select("conv_id", F.array_join(providers.by_index(F.col("answers")).cast("array<string>"), ",").alias("lengths"))


@registered(
    "WITH c AS (SELECT event_type || ':' || user_id AS cache_key, event_id AS response, CAST(floor(epoch(ts)) AS BIGINT) AS created_at FROM events), "
    "last AS (SELECT cache_key, arg_max(response, (created_at, response)) AS response, max(created_at) AS created_at FROM c GROUP BY cache_key), "
    "live AS (SELECT * FROM last WHERE created_at + 86400 > (SELECT max(created_at) FROM c)), "
    "asked AS (SELECT DISTINCT 'click:' || doc_id AS cache_key FROM documents UNION SELECT DISTINCT 'view:' || doc_id FROM documents) "
    "SELECT a.cache_key, CAST(l.response AS BIGINT) AS response FROM asked a LEFT JOIN live l USING (cache_key)"
)
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a live cache answers, and what is left to ask a provider for."""
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("i"))
    asked = d.select(F.concat(F.lit("click:"), "i").alias("cache_key")).union(d.select(F.concat(F.lit("view:"), "i"))).distinct()
    stored = rq.cache(spark, sf_dir)
    known, open_ = providers.cached(asked, stored, rq.now(stored))
    return known.unionByName(open_.withColumn("response", F.lit(None).cast("long")))


@registered(
    "SELECT item_id, 'expand:m1:' || text AS expand_key, 'hyde:m1:' || text AS hyde_key, 'rerank:m2:' || text || ':' || sha1(array_to_string(string_split(text, ' ')[1:3], chr(1))) AS rerank_key FROM benchmark"
)
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "benchmark").select(
        "item_id", codecs.cache_key("expand", "m1", text).alias("expand_key"), codecs.cache_key("hyde", "m1", text).alias("hyde_key"),
        codecs.cache_key("rerank", "m2", text, F.slice(F.split(text, " "), 1, 3)).alias("rerank_key"),
    )


@registered(
    "WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: x <> '')[1:3] AS words FROM benchmark) "
    "SELECT item_id, CASE WHEN item_id % 6 <> 5 AND len(words) > 0 THEN array_to_string(words, ' ') END AS expansions FROM w"
)
def expansion_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives read from answers of six shapes: bare, fenced, wrapped, under any name, within prose, and unreadable."""
    words = F.slice(F.filter(F.split("text", "[^A-Za-z]+"), lambda x: x != ""), 1, 3)
    listed = F.concat(F.lit("["), F.array_join(F.transform(words, lambda w: F.concat(F.lit('" '), w, F.lit('"'))), ", "), F.lit(', null, ""]'))
    kind = F.col("item_id") % 6
    raw = (
        F.when(kind == 0, listed).when(kind == 1, F.concat(F.lit("```json\n"), listed, F.lit("\n```"))).when(kind == 2, F.concat(F.lit('{"queries": '), listed, F.lit("}")))
        .when(kind == 3, F.concat(F.lit('{"n": 1, "other": '), listed, F.lit("}"))).when(kind == 4, F.concat(F.lit("Try these: "), listed, F.lit(" or so"))).otherwise(F.lit("no list here"))
    )
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(responses.expansions(raw), " ").alias("expansions"))


@registered(
    "WITH p AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: x <> ''))) AS doc FROM benchmark), "
    "r AS (SELECT item_id, doc, length(doc) / 10.0::DOUBLE AS score FROM p) "
    "SELECT item_id, count(*) AS placed, round(max(score), 4) AS best, round(sum(score), 4) AS total FROM r WHERE length(doc) % 4 <> 3 GROUP BY item_id"
)
def rerank_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker's results placed by index or by text; places that don't exist are dropped."""
    docs = F.array_distinct(F.filter(F.split("text", "[^A-Za-z]+"), lambda x: x != ""))
    null = lambda kind: F.lit(None).cast(kind)

    def result(doc: Column, i: Column) -> Column:
        kind, n = F.length(doc) % 4, F.length(doc) / 10.0
        index = F.when(kind == 0, i.cast("int")).when(kind == 3, (i + 100_000).cast("int"))
        return F.struct(
            index.alias("index"), F.when(kind < 2, n).alias("relevance_score"), F.when(kind >= 2, n).otherwise(null("double")).alias("score"),
            F.when(kind > 0, doc).alias("document"),
        )

    made = table(spark, sf_dir, "benchmark").select("item_id", docs.alias("docs")).withColumn("results", F.transform("docs", result))
    placed = made.select("item_id", F.explode(responses.reranked(F.col("results"), F.col("docs"))).alias("r"))
    return placed.groupBy("item_id").agg(F.count(F.lit(1)).alias("placed"), F.round(F.max("r.score"), 4).alias("best"), F.round(F.sum("r.score"), 4).alias("total"))


# --- search --------------------------------------------------------------------------------------


@registered(
    f"WITH {_bm25((2, 1))}, {_VECTORS}, {_near('near', _ITEM_VECTORS, 40, least='score >= 0.3')}, "
    "hq AS (SELECT item_id, CAST((item_id + 1) % (SELECT count(*) FROM embeddings) AS BIGINT) AS v FROM benchmark), "
    "hyde_all AS (SELECT item_id AS query_id, d.vec_id AS chunk_id, round(greatest(list_inner_product(q.v, d.v), 0), 6) AS score FROM hq JOIN unit q ON q.vec_id = hq.v, unit d), "
    "hyde AS (SELECT * FROM hyde_all WHERE score >= 0.3), "
    f"lists AS ({_list(0, 'scored', 2)} UNION ALL {_list(1, 'near', 2)} UNION ALL {_list(2, 'hyde', 1)}), {_FUSE}{_FUSED_OUT}"
)
def rrf_with_hyde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexical list, the query's vector list, and one of weight 1 for the vector of a made-up answer (the next vector)."""
    v = saved(rq.vectors(spark, sf_dir))
    n = v.count()
    items = table(spark, sf_dir, "benchmark").select("item_id", ((F.col("item_id") + 1) % max(n, 1)).alias("id"))
    made_up = items.join(v.select("id", "embedding"), "id").select(F.col("item_id").alias("id"), "embedding")
    lists = [
        fusion.RankedList(rq.lexical_list(spark, sf_dir, (2, 1)), counts_when_empty=True), fusion.RankedList(rq.vector_list(spark, sf_dir, 0.3)),
        fusion.RankedList(neighbours(made_up, v, 40, 0.3).drop("rank"), fusion.EXPANDED_WEIGHT),
    ]
    return rq.fused_rows(fusion.fused(lists))


@registered(
    "WITH q AS (SELECT item_id AS query_id, text, string_split(text, chr(10)) AS l FROM benchmark), "
    "u AS (SELECT query_id, len(list_distinct(list_append(l, text))) AS n FROM q) "
    "SELECT query_id, CASE WHEN n > 1 THEN n ELSE 0 END AS expanded, CASE WHEN query_id IN (SELECT vec_id FROM embeddings) THEN 0 ELSE 1 END AS warnings FROM u"
)
def search_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries each item is searched by, and whether its missing vector is worth a warning."""
    embedded = rq.vectors(spark, sf_dir).select(F.col("id").alias("query_id"), "embedding")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.split("text", "\n").alias("expansions"))
    d = described(q.join(embedded, "query_id", "left"), Options(mode="vector"))
    return d.select("query_id", F.size("expanded_queries").alias("expanded"), F.size("warnings").alias("warnings"))


def han_text(words: Column) -> Column:
    """Words as Han characters, one each and none between: the character is drawn from the word's hash."""
    code = F.conv(F.substring(F.md5(F.lower(words)), 1, 6), 16, 10).cast("int") % 6000 + 0x4E00
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def han_documents(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    rows = table(spark, sf_dir, name).select(F.col(key).alias("id"), F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    return rows.select("id", F.transform("w", han_text).alias("h"))


_HAN = (
    "hd AS (SELECT doc_id AS chunk_id, [chr(CAST(('0x' || substr(md5(lower(w)), 1, 6))::BIGINT % 6000 + 19968 AS INTEGER)) FOR w IN regexp_split_to_array(text, '\\s+') IF w <> ''] AS h FROM documents), "
    "hs AS (SELECT chunk_id, array_to_string(h, '') AS whole, CASE WHEN len(h) < 2 THEN h ELSE [h[i] || h[i + 1] FOR i IN range(1, len(h))] END AS seg FROM hd), "
    "chunks AS (SELECT chunk_id, CASE WHEN whole = '' THEN [] ELSE list_concat([whole], [s FOR s IN list_distinct(seg) IF s <> whole]) END AS t FROM hs), "
    "hq AS (SELECT item_id AS query_id, [chr(CAST(('0x' || substr(md5(lower(w)), 1, 6))::BIGINT % 6000 + 19968 AS INTEGER)) FOR w IN regexp_split_to_array(text, '\\s+') IF w <> ''][2:5] AS h FROM benchmark), "
    "items AS (SELECT query_id, list_distinct(list_concat([array_to_string(h, '')], [h[i] || h[i + 1] FOR i IN range(1, len(h))])) AS t FROM hq), "
    f"{_INDEX.replace('items AS', 'unused AS')}, "
    "asked AS (SELECT query_id, term AS phrase_id, 1 AS n_terms, term, 0 AS shift FROM (SELECT query_id, unnest(t) AS term FROM items) WHERE term <> '')"
)


@registered(f"WITH {_HAN}, {_SCORED.format(digits=6)} {_top('scored', 10)}")
def han_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han text made of the documents' words: indexed with its segments, and asked for by four characters of each item."""
    docs = han_documents(spark, sf_dir, "documents", "doc_id").select(F.col("id").alias("chunk_id"), F.array_join("h", "").alias("content"))
    index = saved(lexical.analyzed(docs))
    asked = han_documents(spark, sf_dir, "benchmark", "item_id").select(F.col("id").alias("query_id"), F.array_join(F.slice("h", 2, 4), "").alias("q"))
    found = lexical.bm25(asked.select("query_id", phrases_of(F.col("q"), Options().segmenter(F.col("q"))).alias("phrases")), index, lexical.statistics(index))
    return rq.results(lexical.top(found.withColumn("score", F.round("score", 6)), 10))


# --- recall --------------------------------------------------------------------------------------

_MEMORY = (
    f"{_WHOLE}{_SCORED.format(digits=12)}, best AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS share, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)"
)


@registered(
    f"{_MEMORY} SELECT query_id, rank, {_PATH.replace('doc_id', 'd.doc_id')} AS path, source AS collection, round(least(share, 1), 6) AS score, "
    f"'Source: ' || {_PATH.replace('doc_id', 'd.doc_id')} || '#' || start_line AS citation FROM best JOIN pieces p USING (chunk_id) JOIN documents d ON p.doc_id = d.doc_id WHERE rank <= 6 AND share >= 0.01"
)
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole item asked of the memory: six chunks at most, with the line they cite."""
    asked = rq.item_tokens(spark, sf_dir).select("query_id", F.array_join("t", " ").alias("query"))
    options = Options(mode="bm25", limit=6, min_score=0.0, min_result_score=0.01, highlight=False)
    found = recall.memory_search(asked, shared_index(spark, sf_dir).corpus(), options)
    return found.select("query_id", "rank", "path", "collection", F.round("score", 6).alias("score"), F.element_at(F.split("content", "\n"), -1).alias("citation"))


@registered(
    f"WITH live AS (SELECT {_PATH} AS path, doc_id, text FROM documents WHERE doc_id % 5 <> 0), asked AS (SELECT {_PATH} AS path FROM documents UNION SELECT {_PATH} || '.bak' FROM documents WHERE doc_id % 2 = 0) "
    "SELECT a.path, md5(coalesce(CASE WHEN doc_id % 3 <> 0 THEN text END, '')) AS content_md5 FROM asked a LEFT JOIN live l USING (path)"
)
def memory_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files asked for by path: as they are now if they are indexed, else empty."""
    d = documents(spark, sf_dir).select("doc_id", path_of().alias("path"), F.col("text").alias("content"))
    asked = d.select("path").union(d.where("doc_id % 2 = 0").select(F.concat("path", F.lit(".bak"))))
    got = recall.memory_get(asked, d.where("doc_id % 3 <> 0"), d.where("doc_id % 5 <> 0").select("path", "content"))
    return got.select("path", F.md5("content").alias("content_md5"))


@registered(
    "SELECT conv_id, turn, text || CASE WHEN turn > 0 THEN chr(10) || 'Source: /' || role || '#' || turn ELSE chr(10) || 'Source: /' || role END AS cited, text AS plain FROM conversations"
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with where they come from, the line where there is one, and as they are with citing turned off."""
    file = F.concat(F.lit("/"), F.col("role"))
    on, off = (recall.cited(F.col("text"), file, F.col("turn"), mode) for mode in ("auto", "off"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", on.alias("cited"), off.alias("plain"))


# --- benchmark tables ----------------------------------------------------------------------------


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items as topics, and labelled documents as judgements of the query that their id's remainder names."""
    topics = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return topics, table(spark, sf_dir, "labels").select((F.col("doc_id") % 97).alias("query_id"), "doc_id", F.col("quality").alias("relevance"))


@registered(
    "WITH q AS (SELECT doc_id % 97 AS query_id, doc_id, quality AS relevance FROM labels), t AS (SELECT item_id AS query_id FROM benchmark WHERE item_id IN (SELECT query_id FROM q) ORDER BY item_id LIMIT 30) "
    "SELECT query_id, count(*) AS judgements, CAST(sum(relevance) AS BIGINT) AS relevant FROM q WHERE query_id IN (SELECT query_id FROM t) GROUP BY query_id"
)
def judged_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 topics that have a judgement, and what is judged for them."""
    topics, judgements = judged(spark, sf_dir)
    some = benchmarks.topics_with_judgements(topics, judgements, "query_id", 30)
    kept = benchmarks.judgements_of(judgements, some)
    return kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("judgements"), F.sum("relevance").cast("long").alias("relevant"))


@registered(
    "WITH p AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'notes.txt' ELSE 'corpus/docs-' || doc_id || '.jsonl.gz' END AS path FROM documents) "
    "SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id % 4 <> 0 THEN doc_id ELSE 9223372036854775807 END, path, doc_id) AS place FROM p"
)
def natural_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus files by the number in their name, others last."""
    path = F.when(F.col("doc_id") % 4 == 0, "notes.txt").otherwise(F.concat(F.lit("corpus/docs-"), F.col("doc_id").cast("string"), F.lit(".jsonl.gz")))
    rows = documents(spark, sf_dir).select("doc_id", benchmarks.natural_order(path).alias("o")).select("doc_id", F.col("o.number").alias("number"), F.col("o.path").alias("path"))
    return catalog.numbered(rows, ["number", "path", "doc_id"], "place").select("doc_id", F.col("place").cast("long").alias("place"))


@registered(
    "WITH p AS (SELECT doc_id, 'doc/' || doc_id || '#' || lang AS id, CASE WHEN doc_id % 2 = 0 THEN '  Title ' || doc_id || ' ' END AS title, text FROM documents) "
    "SELECT doc_id, rtrim(replace(replace(base64(encode(id)), '+', '-'), '/', '_'), '=') AS name, replace(replace(base64(encode(id)), '+', '-'), '/', '_')[1:2] AS shard, id AS back, "
    "md5(CASE WHEN title IS NULL THEN '' ELSE trim(title) || CASE WHEN trim(coalesce(text, ''), ' ') <> '' THEN chr(10) || chr(10) ELSE '' END END || trim(coalesce(text, ''), ' ') || chr(10)) AS content_md5 FROM p"
)
def passage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that each passage is written to, what its name decodes to, and its text: title and body."""
    key = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit("#"), F.col("lang"))
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  Title "), F.col("doc_id").cast("string"), F.lit(" ")))
    rows = documents(spark, sf_dir).select("doc_id", codecs.safe_name(key).alias("name"), F.md5(benchmarks.passage_text(title, F.col("text"))).alias("content_md5"))
    return rows.select("doc_id", "name", F.substring("name", 1, 2).alias("shard"), codecs.safe_value(F.col("name")).alias("back"), "content_md5")


def written(rows: DataFrame, *folders: str) -> str:
    """Lines (value, and columns that name folders) as text files in a new folder; its path."""
    at = new_path(rows.sparkSession)
    (rows.write.partitionBy(*folders) if folders else rows.write).text(at)
    return at


@registered("SELECT item_id AS query_id, md5(regexp_replace(text, '\\s+', ' ', 'g')) AS query_md5 FROM benchmark")
def topics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written as lines of a topics file and read again."""
    line = F.concat(F.col("item_id").cast("string"), F.lit("\t"), F.regexp_replace("text", r"\s+", " "))
    read = benchmarks.topics(spark, written(table(spark, sf_dir, "benchmark").select(line.alias("value"))))
    return read.select(F.col("query_id").cast("long").alias("query_id"), F.md5("query").alias("query_md5"))


@registered(
    "SELECT CAST(doc_id % 97 AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS INTEGER) AS relevance, 'wide' AS form FROM labels UNION ALL "
    "SELECT CAST(doc_id % 97 AS VARCHAR), CAST(doc_id AS VARCHAR), CAST(quality AS INTEGER), 'narrow' FROM labels"
)
def judgements_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as judgements in both forms, four columns and three with a header, and read again."""
    rows = judged(spark, sf_dir)[1].select(*[F.col(c).cast("string") for c in ("query_id", "doc_id", "relevance")])
    wide = rows.select(F.concat_ws(" ", "query_id", F.lit("0"), "doc_id", "relevance").alias("value"))
    narrow = rows.select(F.concat_ws("\t", "query_id", "doc_id", "relevance").alias("value"))
    header = spark.range(1).select(F.lit("query-id\tcorpus-id\tscore").alias("value"))
    read = [benchmarks.judgements(spark, written(w)).withColumn("form", F.lit(form)) for w, form in ((wide, "wide"), (narrow.union(header), "narrow"))]
    return read[0].unionByName(read[1])


@registered(
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5('Title ' || doc_id || CASE WHEN trim(coalesce(text, ''), ' ') <> '' THEN chr(10) || chr(10) ELSE '' END || trim(coalesce(text, ''), ' ') || chr(10)) AS content_md5 FROM documents"
)
def corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines of a corpus, gzipped, and read again as titles and texts."""
    at = new_path(spark)
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("_id"), F.concat(F.lit(" Title "), F.col("doc_id").cast("string")).alias("title"), "text")
    rows.write.option("compression", "gzip").json(at)
    return benchmarks.corpus(spark, at).select("doc_id", F.md5("content").alias("content_md5"))


@registered(
    f"WITH {_bm25((2, 1))}, run AS ({_top('scored', 10)}) SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(rank AS INTEGER) AS rank, score, 'tessera' AS name FROM run"
)
def run_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run written as lines and read again."""
    read = benchmarks.read_run(spark, written(benchmarks.run_lines(rq.bm25_single_term(spark, sf_dir), "tessera")))
    return read.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"), "name")


@registered(
    "SELECT source AS folder, count(*) * 41 AS chars, true AS titled, 0 AS errors FROM documents WHERE source NOT IN ('src3') GROUP BY source"
)
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files in folders by source, found below their root but for an ignored folder: how much is in each folder."""
    at = written(documents(spark, sf_dir).select(F.concat(F.lit("source="), "source").alias("folder"), F.sha1(F.coalesce("text", F.lit(""))).alias("value")), "folder")
    found = files(spark, at, "c", ignore=("folder=source%3Dsrc3",))
    folder = F.regexp_extract("relative", r"folder=source%3D([^/]+)/", 1)
    return found.groupBy(folder.alias("folder")).agg(
        F.sum(F.length("content")).cast("long").alias("chars"), F.every(F.startswith("title", F.lit("part-"))).alias("titled"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )


@registered(
    f"WITH d AS (SELECT source AS collection, {_PATH} AS path, doc_id FROM documents), asked AS (SELECT collection, path FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT collection, path || '.none' FROM d WHERE doc_id % 3 = 0) "
    "SELECT a.collection, a.path, d.doc_id FROM asked a LEFT JOIN d USING (collection, path)"
)
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents looked up by collection and path, all at once; null where there is none."""
    d = catalog_tables(spark, sf_dir)["documents"]
    asked = d.where("doc_id % 2 = 0").select("collection", "path").unionByName(d.where("doc_id % 3 = 0").select("collection", F.concat("path", F.lit(".none")).alias("path")))
    return catalog.looked_up(asked, d, ["collection", "path"])


@registered(
    "WITH m AS (SELECT unnest(['bm25', 'vector', 'hybrid']) AS mode), i AS (SELECT item_id FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)), "
    f"s AS (WITH {_bm25((2, 1))}, {_VECTORS}, {_near('near', _ITEM_VECTORS, 40, where='vec_id IN (SELECT doc_id FROM documents)', least='score >= 0.3')}, "
    "l AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored) WHERE r <= 40 AND query_id IN (SELECT item_id FROM i)), "
    "e AS (SELECT 'bm25' AS mode, * FROM l UNION SELECT 'hybrid', * FROM l UNION SELECT 'vector', query_id, chunk_id FROM near UNION SELECT 'hybrid', query_id, chunk_id FROM near) SELECT * FROM e) "
    "SELECT mode, query_id, least(count(*), 10) AS results FROM s GROUP BY mode, query_id"
)
def search_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results each mode has for an item's second token and vector: the lists that a mode leaves out are never made."""
    d = documents(spark, sf_dir)
    chunks = d.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    own = d.select("doc_id", path_of().alias("title"), path_of().alias("path"), F.col("source").alias("collection"))
    index, stats = rq.indexed(spark, sf_dir)
    vectors = rq.vectors(spark, sf_dir).select(F.col("id").alias("chunk_id"), "embedding")
    words = F.coalesce(F.get("t", F.lit(1)), F.lit(""))
    asked = rq.item_tokens(spark, sf_dir).select("query_id", words.alias("query")).join(vectors.withColumnRenamed("chunk_id", "query_id"), "query_id")
    corpus = Corpus(chunks, index, stats, vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), own)
    parts = []
    for mode in ("bm25", "vector", "hybrid"):
        found = search(asked, corpus, Options(mode=mode, min_score=0.3, min_result_score=0.0, highlight=False))
        parts.append(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("results")).select(F.lit(mode).alias("mode"), "query_id", "results"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
