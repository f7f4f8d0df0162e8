"""Registered queries that build, change and read a stored index, each with its SQL beside it.

``shared_index`` is the index of all documents, which a session builds once for each set of tables; the queries that
only read it share it, as searches of one index do.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.providers import LetterProvider
from tessera.functions.responses import highlighted
from tessera.jobs import indexing, segments
from tessera.jobs.retrieval_queries import Query, item_tokens
from tessera.jobs.retrieval_sql import _FUSE, _PIECES, _SCORED, _WHOLE
from tessera.jobs.shared import documents, path_of, shared_index, table
from tessera.operators import lexical
from tessera.operators.provided import embedded_chunks, provided_search
from tessera.operators.scratch import broadcast_if_small, new_path, saved
from tessera.operators.search import Options, search, warned
from tessera.sources.archives import zipped_corpus
from tessera.sources.passages import write_passages
from tessera.streaming.changes import changed_files, file_system

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return put


def as_files(docs: DataFrame, text: Column | None = None, mtime: Column | None = None) -> DataFrame:
    """Documents as the listing of a collection's files."""
    text = F.col("text") if text is None else text
    return docs.select(
        F.col("source").alias("collection"), path_of().alias("path"), path_of().alias("title"), (F.col("n_chars") if mtime is None else mtime).cast("double").alias("mtime"),
        F.sha1(text).alias("hash"), text.alias("content"), F.lit(False).alias("markdown"),
    )


@registered(f"{_PIECES} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM post GROUP BY term")
def index_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of the index of all chunks, as a search reads it: each term's chunks and occurrences."""
    index = shared_index(spark, sf_dir)
    terms = index._every(lambda s: index.read(s, "terms"))
    return terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


@registered(
    f"{_PIECES}, asked AS (SELECT DISTINCT t AS query_id, 0 AS phrase_id, 1 AS n_terms, t AS term, 0 AS shift FROM (SELECT unnest(t) AS t FROM items)), {_SCORED.format(digits=6)} "
    "SELECT query_id AS term, rank, chunk_id // 1048576 AS doc_id, CAST(chunk_id % 1048576 AS INTEGER) AS chunk_idx, score FROM "
    "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10"
)
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of the items as a query of its own: folders that can't hold one of a term's ten best aren't read for it."""
    index = shared_index(spark, sf_dir)
    term = item_tokens(spark, sf_dir).select(F.explode("t").alias("query_id")).distinct()
    asked = term.select("query_id", F.array(F.array("query_id")).alias("phrases"))
    found = lexical.bm25(asked, index.inverted(), index.statistics(), limit=10, digits=6)
    return lexical.top(found, 10).select(F.col("query_id").alias("term"), "rank", segments.doc_of(F.col("chunk_id")).alias("doc_id"), (F.col("chunk_id") % indexing.CHUNKS_OF_A_DOCUMENT).cast("int").alias("chunk_idx"), "score")


_WORD = "[\\p{L}\\p{N}\\p{Co}]+"
#: Windows of 20 tokens by their matches: each match's own, moved to have its matches in the middle, and its sentence's.
_MARKED = (
    f"{_PIECES}, asked AS (SELECT query_id, i // 3 AS phrase_id, CAST(least(3, n - i // 3 * 3) AS BIGINT) AS n_terms, term, i % 3 AS shift FROM "
    "(SELECT query_id, len(t) AS n, unnest(t) AS term, unnest(range(len(t))) AS i FROM items)), "
    f"{_SCORED.format(digits=6)}, found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10), "
    f"texts AS (SELECT chunk_id, regexp_extract_all(content, '{_WORD}') AS toks, regexp_split_to_array(content, '{_WORD}') AS gaps FROM pieces WHERE chunk_id IN (SELECT chunk_id FROM found)), "
    "spans AS (SELECT DISTINCT m.query_id, m.chunk_id, m.phrase_id AS k, start AS a, start + n_terms AS b FROM met m JOIN found USING (query_id, chunk_id) "
    "JOIN (SELECT DISTINCT query_id, phrase_id, n_terms FROM asked) USING (query_id, phrase_id)), "
    "sentences AS (SELECT chunk_id, i FROM (SELECT chunk_id, unnest(range(len(toks))) AS i, gaps FROM texts) WHERE i = 0 OR regexp_matches(gaps[i + 1], '[.:][ \\t\\n\\r]+$')), "
    "firsts AS (SELECT DISTINCT query_id, chunk_id, a FROM spans), "
    "begun AS (SELECT query_id, chunk_id, a, max(i) AS s FROM firsts JOIN sentences USING (chunk_id) WHERE i <= a GROUP BY ALL), "
    "wins AS (SELECT query_id, chunk_id, a AS first, 0 AS kind, a AS w FROM firsts UNION ALL SELECT query_id, chunk_id, a, 1, s FROM begun JOIN texts USING (chunk_id) WHERE s < a AND len(toks) > 20), "
    "held AS (SELECT x.query_id, x.chunk_id, first, kind, w, count(DISTINCT k) * 999 + count(*) + max(CASE WHEN kind = 0 THEN 0 WHEN w = 0 THEN 120 ELSE 100 END) AS weight, arg_max(b, a * 100000 + k) AS last "
    "FROM wins x JOIN spans s ON x.query_id = s.query_id AND x.chunk_id = s.chunk_id AND a >= w AND a < w + 20 GROUP BY x.query_id, x.chunk_id, first, kind, w), "
    "best AS (SELECT query_id, chunk_id, n, w, least(n, w + 20) AS e FROM (SELECT query_id, chunk_id, len(toks) AS n, CASE kind WHEN 0 THEN "
    "CAST(greatest(0, least(first - trunc((20 - (last - first)) / 2), len(toks) - 20)) AS BIGINT) ELSE w END AS w, "
    "row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY weight DESC, first, kind) AS place FROM held JOIN texts USING (chunk_id)) WHERE place = 1), "
    "islands AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id, chunk_id ORDER BY a, k) AS island FROM (SELECT *, CASE WHEN a < max(b) OVER "
    "(PARTITION BY query_id, chunk_id ORDER BY a, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans)), "
    "marks AS (SELECT query_id, chunk_id, min(a) AS a, max(b) AS b FROM islands GROUP BY query_id, chunk_id, island), "
    "inside AS (SELECT query_id, chunk_id, n, w, e, unnest(range(w, e)) AS i FROM best), "
    "pieced AS (SELECT p.query_id, p.chunk_id, n, w, e, i, CASE WHEN i = w AND w > 0 THEN '…' ELSE gaps[i + 1] END || CASE WHEN o.a IS NULL THEN '' ELSE '**' END || toks[i + 1] || "
    "CASE WHEN c.a IS NULL THEN '' ELSE '**' END || CASE WHEN i < e - 1 THEN '' WHEN e < n THEN '…' ELSE gaps[n + 1] END AS piece FROM inside p JOIN texts USING (chunk_id) "
    "LEFT JOIN marks o ON o.query_id = p.query_id AND o.chunk_id = p.chunk_id AND o.a = i "
    "LEFT JOIN marks c ON c.query_id = p.query_id AND c.chunk_id = p.chunk_id AND c.a >= w AND c.a < e AND least(c.b, e) - 1 = i), "
    "shown AS (SELECT query_id, chunk_id, string_agg(piece, '' ORDER BY i) AS snippet FROM pieced GROUP BY ALL) "
    "SELECT query_id, rank, chunk_id // 1048576 AS doc_id, CAST(chunk_id % 1048576 AS INTEGER) AS chunk_idx, score, snippet FROM found JOIN shown USING (query_id, chunk_id)"
)


@registered(_MARKED)
def marked_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks for whole items, asked as phrases of three tokens in a row, each with its best window and its matches marked."""
    index = shared_index(spark, sf_dir)
    triples = F.transform(F.sequence(F.lit(0), (F.size("t") - 1).cast("int"), F.lit(3)), lambda i: F.slice("t", i + 1, 3))
    asked = saved(item_tokens(spark, sf_dir).where(F.size("t") > 0).select("query_id", triples.alias("phrases")))
    found = saved(lexical.top(lexical.bm25(asked, index.inverted(), index.statistics(), limit=10, digits=6), 10))
    shown = index.corpus(None).with_content(found).join(asked, "query_id")
    return shown.select(
        "query_id", "rank", segments.doc_of(F.col("chunk_id")).alias("doc_id"), (F.col("chunk_id") % indexing.CHUNKS_OF_A_DOCUMENT).cast("int").alias("chunk_idx"),
        "score", highlighted("content", "phrases").alias("snippet"),
    )


def three_states(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three states of a collection: without every tenth document and with others' texts older; mended, with some gone; and whole but for those."""
    d = documents(spark, sf_dir)
    older = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("an older text\n"), "text")).otherwise(F.col("text"))
    before = as_files(d.where("doc_id % 10 <> 0"), older, F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") - 1).otherwise(F.col("n_chars")))
    return [before, as_files(d.where("doc_id % 10 <> 0 AND doc_id % 11 <> 0")), as_files(d.where("doc_id % 11 <> 0"))]


@registered(
    _WHOLE.replace("FROM documents WHERE regexp_matches", "FROM documents WHERE doc_id % 11 <> 0 AND regexp_matches", 1) + f"{_SCORED.format(digits=6)} "
    "SELECT query_id, rank, chunk_id // 1048576 AS doc_id, CAST(chunk_id % 1048576 AS INTEGER) AS chunk_idx, score FROM "
    "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10"
)
def search_over_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole items asked of an index of three segments with changed, removed and added documents: as of one that is made anew."""
    root = new_path(spark)
    for state in three_states(spark, sf_dir):
        indexing.refresh(spark, root, state, merging=False)
    index = segments.current(spark, root)
    asked = item_tokens(spark, sf_dir).where(F.size("t") > 0).select("query_id", F.array("t").alias("phrases"))
    found = saved(lexical.bm25(asked, index.inverted(), index.statistics(), digits=6))
    # documents have the index's own ids: ties go by those of the table, as their paths name them
    named = index.documents.select("doc_id", F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("long").alias("of"))
    placed = broadcast_if_small(found.withColumn("doc_id", segments.doc_of(F.col("chunk_id")))).join(named, "doc_id")
    placed = placed.select("query_id", F.col("of").alias("doc_id"), (F.col("chunk_id") % indexing.CHUNKS_OF_A_DOCUMENT).cast("int").alias("chunk_idx"), "score")
    return lexical.top(placed, 10, "doc_id", "chunk_idx").select("query_id", "rank", "doc_id", "chunk_idx", "score")


@registered(
    f"{_PIECES}, kept AS (SELECT doc_id % 3 AS k, count(*) AS n FROM pieces GROUP BY 1) "
    "SELECT CASE d.k WHEN 0 THEN 'error' WHEN 1 THEN 'mtime_only' ELSE 'skipped' END AS status, d.n AS documents, CAST(coalesce(kept.n, 0) AS BIGINT) AS chunks "
    "FROM (SELECT doc_id % 3 AS k, count(*) AS n FROM documents GROUP BY 1) d LEFT JOIN kept ON d.k = kept.k"
)
def refresh_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh in which every third file can't be read and every third has another time: by status, the files and the chunks that the index has of them."""
    root, d = new_path(spark), documents(spark, sf_dir)
    indexing.refresh(spark, root, as_files(d))
    third = F.col("doc_id") % 3
    # what a listing says of files that can't be read: a new time, and neither content nor hash
    again = as_files(d, F.when(third != 0, F.col("text")), F.when(third == 2, F.col("n_chars")).otherwise(F.col("n_chars") + 1))
    failed = F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("long") % 3 == 0
    status = saved(indexing.refresh(spark, root, again.withColumn("error", F.when(failed, F.lit("unreadable")))))
    index = segments.current(spark, root)
    own = index.documents.select("doc_id", (F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("long") % 3).alias("k"))
    held = index.chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(own, "doc_id").groupBy("k").agg(F.sum("n").alias("chunks"))
    kinds = F.when(F.col("k") == 0, "error").when(F.col("k") == 1, "mtime_only").otherwise("skipped")
    return status.join(held.select(kinds.alias("status"), "chunks"), "status", "left").select("status", "documents", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


_LETTERS = ", ".join(f"'{c}'" for c in "etaoinsr")


def _letters(text: str) -> str:
    """A text's vector as the stand-in makes it: unit length, single precision."""
    counts = f"[CAST(length(lower({text})) - length(replace(lower({text}), l, '')) AS DOUBLE) FOR l IN [{_LETTERS}]]"
    return f"(SELECT list_transform(v, lambda x: (x / CASE WHEN n = 0 THEN 1 ELSE n END)::FLOAT) FROM (SELECT v, sqrt(list_inner_product(v, v)) AS n FROM (SELECT {counts} AS v)))"


def _lists(names: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT query_id, chunk_id, score, {i} AS list_ord, {2 if name.endswith('0') else 1}::DOUBLE AS weight, r FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS r FROM ({rows})) WHERE r < 40"
        for i, (name, rows) in enumerate(names)
    )


_PROVIDED = (
    f"{_PIECES}, words AS (SELECT query_id, t, (len(t) + 1) // 2 AS half FROM items WHERE len(t) > 0), "
    "asks AS (SELECT query_id, 0 AS k, t FROM words UNION ALL SELECT query_id, 1, t[1:half] FROM words WHERE half < len(t) UNION ALL "
    "SELECT query_id, 2, t[half + 1:] FROM words WHERE half < len(t) AND t[half + 1:] <> t[1:half]), "
    "asked AS (SELECT query_id * 10 + k AS query_id, 0 AS phrase_id, len(t) AS n_terms, unnest(t) AS term, unnest(range(len(t))) AS shift FROM asks), "
    f"{_SCORED.format(digits=12)}, "
    f"cv AS (SELECT chunk_id, list_transform({_letters('content')}, lambda x: x::DOUBLE) AS v FROM pieces), "
    "cu AS (SELECT chunk_id, list_transform(v, lambda x: x / CASE WHEN list_inner_product(v, v) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END) AS v FROM cv), "
    f"qt AS (SELECT query_id, k, array_to_string(t, ' ') AS text FROM asks UNION ALL SELECT query_id, 3, array_to_string(list_reverse(t), ' ') FROM words), "
    f"qv AS (SELECT query_id, k, list_transform({_letters('text')}, lambda x: x::DOUBLE) AS v FROM qt), "
    "qu AS (SELECT query_id, k, list_transform(v, lambda x: x / CASE WHEN list_inner_product(v, v) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END) AS v FROM qv), "
    "near AS (SELECT q.query_id, k, chunk_id, round(greatest(list_inner_product(q.v, c.v), 0), 6) AS score FROM qu q, cu c), "
    "lists AS ("
    + _lists([(f"lexical {k}", f"SELECT query_id // 10 AS query_id, chunk_id, score FROM scored WHERE query_id % 10 = {k}") for k in range(3)]
             + [(f"vector {k}", f"SELECT query_id, chunk_id, score FROM near WHERE k = {k} AND score >= 0.3") for k in range(3)]
             + [("hyde", "SELECT query_id, chunk_id, score FROM near WHERE k = 3 AND score >= 0.3")])
    + f"), {_FUSE}, cand AS (SELECT o.*, content, count(*) OVER (PARTITION BY query_id) AS n, max(o.score) OVER (PARTITION BY query_id) AS best FROM ordered o JOIN pieces USING (chunk_id) WHERE rank <= 40), "
    "told AS (SELECT c.*, (SELECT sum((length(lower(content)) - length(replace(lower(content), w, ''))) / length(w)) FROM (SELECT unnest(t) AS w)) / (1 + length(content)) AS rerank FROM cand c JOIN words USING (query_id)), "
    "sized AS (SELECT *, greatest(max(rerank) OVER (PARTITION BY query_id), 1e-9) AS top_rerank, CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END::DOUBLE AS share FROM told), "
    "mixed AS (SELECT query_id, chunk_id, rank AS was, rerank, CASE WHEN n >= 2 THEN share * score / best + (1 - share) * rerank / top_rerank ELSE score END AS score FROM sized), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rerank DESC, was) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM mixed) "
    "SELECT query_id, rank, chunk_id // 1048576 AS doc_id, CAST(chunk_id % 1048576 AS INTEGER) AS chunk_idx, round(score / top, 6) AS score FROM placed WHERE rank <= 10 AND score / top >= 0.01"
)


@registered(_PROVIDED)
def search_with_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole items asked with a stand-in provider: it expands each into its halves, answers with the words in reverse, embeds by letters and reranks by words."""
    index, provider = shared_index(spark, sf_dir), LetterProvider()
    corpus = index.corpus()
    corpus = replace(corpus, embeddings=saved(embedded_chunks(corpus, provider)))
    asked = item_tokens(spark, sf_dir).where(F.size("t") > 0).select("query_id", F.array_join("t", " ").alias("query"))
    found = provided_search(asked, corpus, provider, Options(min_score=0.3, min_result_score=0.01, highlight=False))
    return found.select("query_id", "rank", segments.doc_of(F.col("chunk_id")).alias("doc_id"), (F.col("chunk_id") % indexing.CHUNKS_OF_A_DOCUMENT).cast("int").alias("chunk_idx"), F.round("score", 6).alias("score"))


@registered(
    f"{_WHOLE}{_SCORED.format(digits=12)}, best AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS share, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) "
    "SELECT query_id, rank, chunk_id // 1048576 AS doc_id, round(share, 6) AS score, 1 AS warnings, true AS told FROM best WHERE rank <= 10 AND share >= 0.01"
)
def search_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole items asked of an index whose vectors are broken (of two widths): the lexical results are there, and one warning with each query."""
    index = shared_index(spark, sf_dir)
    embedded = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * indexing.CHUNKS_OF_A_DOCUMENT).alias("chunk_id"), "embedding")
    broken = embedded.withColumn("embedding", F.when(F.col("chunk_id") % 2 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    asked = item_tokens(spark, sf_dir).where(F.size("t") > 0).select("query_id", F.array_join("t", " ").alias("query"))
    asked = asked.withColumn("embedding", F.array(*[F.lit(float(i)).cast("float") for i in range(5)]))
    warnings: list[str] = []
    found = search(asked, index.corpus(broken), Options(min_score=0.3, min_result_score=0.01, highlight=False), warnings=warnings)
    told = warned(asked, warnings).groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("warnings"), F.every(F.startswith("warning", F.lit("vector search failed"))).alias("told"))
    return found.join(told, "query_id").select("query_id", "rank", segments.doc_of(F.col("chunk_id")).alias("doc_id"), F.round("score", 6).alias("score"), "warnings", "told")


# --- changed files -------------------------------------------------------------------------------


def _file_states(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame | None]]:
    """Files of a hundred documents each, in three looks: (what is written, what goes) before each.

    Files of even numbers come first, then the others while every third of the first changes, and at last every fifth goes.
    """
    digests = documents(spark, sf_dir).select(F.floor(F.col("doc_id") / 100).alias("n"), F.md5(F.coalesce("text", F.lit(""))).alias("d"))
    body = digests.groupBy("n").agg(F.array_join(F.array_sort(F.collect_list("d")), "\n").alias("content"))
    rows = saved(body.select("n", F.concat(F.lit("f"), F.lpad(F.col("n").cast("string"), 12, "0")).alias("name"), "content"))
    changed = rows.where("n % 2 = 0 AND n % 3 = 0").withColumn("content", F.concat("content", F.lit("\nmore")))
    return [(rows.where("n % 2 = 0"), None), (rows.where("n % 2 = 1").unionByName(changed), changed), (rows.limit(0), rows.where("n % 5 = 0"))]


@registered(
    "SELECT n AS file, array_to_string(list_filter([CASE WHEN n % 2 = 0 THEN '1:add' ELSE '2:add' END, CASE WHEN n % 6 = 0 THEN '2:change' END, CASE WHEN n % 5 = 0 THEN '3:unlink' END], lambda x: x IS NOT NULL), ' ') AS events "
    "FROM (SELECT DISTINCT doc_id // 100 AS n FROM documents)"
)
def changed_files_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of files made from all documents and changed in three looks of one stream, which is restarted for each."""
    root, work = new_path(spark), new_path(spark)
    files, at = file_system(root)

    def gone(names: DataFrame) -> None:
        def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in rows:
                for name in pdf["name"]:
                    files.delete_file(f"{at}/{name[:2]}/{name}.txt")
                yield pdf

        names.select("name").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()

    for look, (new, old) in enumerate(_file_states(spark, sf_dir), 1):
        if old is not None:
            gone(old)
        write_passages(new.select("name", "content"), root)

        def keep(rows: DataFrame, batch: int, look: int = look) -> None:
            rows.withColumn("look", F.lit(look)).write.mode("overwrite").parquet(f"{work}/events/batch={batch}")

        stream = changed_files(spark, root, f"{work}/state", settle=0)
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    events = spark.read.parquet(f"{work}/events")
    told = F.concat_ws(":", F.col("look").cast("string"), "op")
    return events.groupBy(F.regexp_extract("path", r"f(\d+)\.txt$", 1).cast("long").alias("file")).agg(F.array_join(F.array_sort(F.collect_list(told)), " ").alias("events"))


@registered(
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5('Title ' || doc_id || CASE WHEN trim(coalesce(text, ''), ' ') <> '' THEN chr(10) || chr(10) ELSE '' END || trim(coalesce(text, ''), ' ') || chr(10)) AS content_md5 FROM documents"
)
def corpus_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines into zip archives of two unequal members, by the tasks that hold them, and read again."""
    root = new_path(spark)
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("_id"), F.concat(F.lit(" Title "), F.col("doc_id").cast("string")).alias("title"), "text"))
    rows = documents(spark, sf_dir).select(line.alias("line"))

    def zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = file_system(root)
        files.create_dir(at)
        for pdf in batches:
            name = f"{at}/{uuid.uuid4().hex}"
            with files.open_output_stream(f"{name}.part") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                few = len(pdf) // 10
                for member, some in (("a/corpus.jsonl", pdf["line"][:few]), ("b/corpus.jsonl", pdf["line"][few:])):
                    z.writestr(member, "".join(f"{x}\n" for x in some))
            yield pd.DataFrame({"name": [name]})

    # tasks may be repeated: the archives of those that count are named, and the others keep the ending of a part
    made = saved(rows.mapInPandas(zipped, "name string"))

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = file_system(root)
        for pdf in batches:
            for name in pdf["name"]:
                if files.get_file_info(f"{name}.part").type != fs.FileType.NotFound:
                    files.move(f"{name}.part", f"{name}.zip")
            yield pdf

    made.mapInPandas(named, "name string").write.format("noop").mode("overwrite").save()
    return zipped_corpus(spark, root).select("doc_id", F.md5("content").alias("content_md5"))
