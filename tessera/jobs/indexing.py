"""Building an index of segments from files, refreshing it, and the vectors of its chunks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.codecs import safe_name
from tessera.functions.han import Segmenter, bigrams
from tessera.functions.providers import Provider, embedded
from tessera.jobs import segments
from tessera.jobs.migrations import migrated
from tessera.jobs.segments import Snapshot, current
from tessera.operators import catalog, lexical
from tessera.operators.chunking import chunked
from tessera.operators.scratch import broadcast_if_small, cleared, saved
from tessera.sources.passages import write_passages

KEYS = ["collection", "path"]
FILE_COLUMNS = ("collection", "path", "title", "mtime", "hash", "content", "markdown", "error")


#: A chunk's id is its document's times this, and its place.
CHUNKS_OF_A_DOCUMENT = 1 << 20


def chunk_id(doc_id: Column, chunk_idx: Column) -> Column:
    """A chunk's id holds its document's; a document of over a million chunks (some 3 GB) is an error."""
    clash = F.raise_error(F.lit(f"a document has over {CHUNKS_OF_A_DOCUMENT} chunks")).cast("long")
    return F.when(chunk_idx < CHUNKS_OF_A_DOCUMENT, doc_id * CHUNKS_OF_A_DOCUMENT + chunk_idx).otherwise(clash)


def indexed_chunks(docs: DataFrame, version: int, segmenter: Segmenter = bigrams) -> DataFrame:
    """The chunks of documents (doc_id, content, markdown) as segments hold them, with their tokens."""
    pieces = chunked(docs).withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_idx")))
    text = lexical.analyzed(pieces.drop("embedding_content"), segmenter=segmenter, kept=[c for c in pieces.columns if c != "embedding_content"])
    return text.withColumn("indexed_in", F.lit(version))


def _no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, collection string, path string, title string, mtime double, hash string, indexed_at long, indexed_in int, noted_in int")


def refresh(
    spark: SparkSession, root: str, files: DataFrame, now: int = 0, segmenter: Segmenter = bigrams, base: Snapshot | None = None, buckets: int = segments.BUCKETS, merging: bool = True
) -> DataFrame:
    """Bring the index to the state of ``files``; the count of documents by status.

    One new segment holds what was added or changed, and notes of what changed its time or was removed; nothing else
    is written, and nothing at all if nothing changed. A file with an ``error`` (an optional column) is counted as
    one and keeps what the index has of it. The listing is read once, and what it says then is what is indexed.
    ``base`` is the version that the change is made to, by default the latest; if another writer has made its
    successor meanwhile, that is a ``Conflict``, and the index stays as that writer left it.
    """
    with cleared(spark):
        if base is None:
            migrated(spark, root)
        old = base or current(spark, root)
        version = old.version + 1 if old else 1
        stored = saved(old.documents) if old else _no_documents(spark)
        if "error" not in files.columns:
            files = files.withColumn("error", F.lit(None).cast("string"))
        before = stored.select(*KEYS, F.col("mtime").alias("__mtime"))
        same = F.col("mtime").eqNullSafe(F.col("__mtime")) & F.col("__mtime").isNotNull()
        seen = files.select(*FILE_COLUMNS).join(broadcast_if_small(before), KEYS, "left")
        # contents of files whose time is as stored aren't written
        seen = saved(seen.withColumn("content", F.when(~same, F.col("content"))).drop("__mtime"))
        status = saved(catalog.change_status(seen, stored, *KEYS))
        counts = spark.createDataFrame([tuple(r) for r in status.groupBy("status").count().collect()], "status string, documents long")
        if old and status.where("status NOT IN ('skipped', 'error')").isEmpty():
            return counts
        of = lambda *kinds: status.where(F.col("status").isin(*kinds)).select(*KEYS)
        ids = stored.select(*KEYS, "doc_id")
        added = catalog.numbered(saved(of("added")), KEYS, "doc_id", old.last_id() if old else 0).select(*KEYS, F.col("doc_id").cast("long").alias("doc_id"))
        owned = saved(ids.join(of("changed"), KEYS, "left_semi").unionByName(added))
        stamp = {"indexed_at": F.lit(now).cast("long"), "indexed_in": F.lit(version), "noted_in": F.lit(version), "removed": F.lit(False)}
        # contents meet the ids of what is new or changed, and nothing else
        made = seen.join(broadcast_if_small(owned), KEYS).withColumns(stamp)
        touched = stored.drop("mtime").join(seen.join(of("mtime_only"), KEYS, "left_semi").select(*KEYS, "mtime"), KEYS).withColumns({"noted_in": F.lit(version), "removed": F.lit(False)})
        gone = stored.join(of("removed"), KEYS, "left_semi").withColumns(stamp | {"removed": F.lit(True)})
        names = [c for c in gone.columns]
        notes = made.select(names).unionByName(touched.select(names)).unionByName(gone)
        chunks = indexed_chunks(made.select("doc_id", "content", "markdown"), version, segmenter)
        dead = None
        if old:
            dying = saved(ids.join(of("changed", "removed"), KEYS, "left_semi").select("doc_id"))
            dead = None if dying.isEmpty() else saved(old.chunks_of(dying))
        buckets = old.buckets if old else buckets
        characters = seen.agg(F.sum(F.length("content"))).first()[0] or 0
        segment = segments.written(spark, root, notes, chunks, buckets, characters, dead)
        at = segments.committed(spark, root, version, (*(old.segments if old else ()), segment), buckets, now)
        while merging and (some := segments.due(at.segments)):
            at = segments.merged(at, some, now)
        return counts


def _vector_meta(spark: SparkSession, root: str):
    """The last row (version, dim, model) of the vectors' log; None before the first."""
    try:
        return spark.read.parquet(f"{root}/vectors/meta").orderBy(F.col("version").desc()).first()
    except AnalysisException:
        return None


def _log_vectors(spark: SparkSession, root: str, version: int, dim: int | None, model: str | None) -> None:
    row = [(version, dim, model)]
    spark.createDataFrame(row, "version int, dim int, model string").coalesce(1).write.mode("append").parquet(f"{root}/vectors/meta")


def vectors(spark: SparkSession, root: str) -> DataFrame | None:
    """chunk_id, embedding of the index's chunks; None before any. Vectors of deleted chunks are not among them."""
    last, index = _vector_meta(spark, root), current(spark, root)
    if last is None or last["dim"] is None or index is None:
        return None
    stored = spark.read.parquet(f"{root}/vectors/v{last['version']}")
    return stored.join(index.tables["chunks"].select("chunk_id", "indexed_in"), ["chunk_id", "indexed_in"], "left_semi").select("chunk_id", "embedding")


def put_vectors(spark: SparkSession, root: str, embeddings: DataFrame, model: str | None = None) -> int:
    """Write vectors (chunk_id, embedding) in place of those of the same chunks; the number of the new version.

    The first ones fix the dimension of all; another one is an error, until ``reset_vectors``. Null vectors are
    passed over, and vectors of chunks that the index no longer has, or has anew, are left behind.
    """
    rows = embeddings.where("embedding IS NOT NULL").select("chunk_id", "embedding")
    seen, last = rows.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first(), _vector_meta(spark, root)
    dim = last["dim"] if last else None
    widths = {w for w in (seen["low"], seen["high"], dim) if w is not None}
    if len(widths) > 1:
        raise ValueError(f"vectors have {seen['low']} to {seen['high']} dimensions, the index {dim}")
    chunks = current(spark, root).tables["chunks"].select("chunk_id", "indexed_in")
    fresh = rows.join(chunks, "chunk_id")
    if dim is not None:
        stored = spark.read.parquet(f"{root}/vectors/v{last['version']}").join(chunks, ["chunk_id", "indexed_in"], "left_semi")
        fresh = catalog.put(stored, fresh.select(stored.columns), ["chunk_id"])
    version = last["version"] + 1 if last else 1
    fresh.write.mode("overwrite").parquet(f"{root}/vectors/v{version}")
    _log_vectors(spark, root, version, next(iter(widths), None), model or (last["model"] if last else None))
    return version


def reset_vectors(spark: SparkSession, root: str) -> None:
    """Forget all vectors and their dimension, so that another model's can be put."""
    last = _vector_meta(spark, root)
    if last is not None:
        _log_vectors(spark, root, last["version"] + 1, None, None)


def embed_missing(spark: SparkSession, root: str, provider: Provider, model: str) -> DataFrame:
    """Vectors for the chunks that have none; how many came and how many failed. Failed ones are asked for again next time."""
    index, known = current(spark, root), vectors(spark, root)
    asked = index.tables["chunks"].select("chunk_id", "embedding_content")
    if known is not None:
        asked = asked.join(known.select("chunk_id"), "chunk_id", "left_anti")
    answers = saved(embedded(asked, provider, "embedding_content").select("chunk_id", "embedding", "failed"))
    put_vectors(spark, root, answers, model)
    return answers.agg(F.count("embedding").alias("embedded"), F.count("failed").alias("failed"))


def synced(spark: SparkSession, root: str, collections: DataFrame, watched: DataFrame, files_of: Callable[[str, str], DataFrame], now: int = 0) -> tuple[DataFrame, DataFrame]:
    """One look at the registered collections (name, path): (events of those that came or went, counts by file status).

    The files of all present collections are what the index is refreshed to; those of a collection that went are
    in none of them, and so are removed.
    """
    events = catalog.collections_changed(collections, watched)
    present = [files_of(r["name"], r["path"]) for r in collections.orderBy("name").collect()]  # a registry, as long as a configuration
    none = spark.createDataFrame([], "collection string, path string, title string, mtime double, hash string, content string, markdown boolean, error string")
    return events, refresh(spark, root, reduce(DataFrame.unionByName, (p.select(*FILE_COLUMNS) for p in present), none), now)


def refreshing(root: str, files_of):
    """A ``foreachBatch`` function: each batch of changes refreshes the index from what ``files_of(spark)`` reads.

    The batch only says that something changed; a refresh that is run twice finds nothing to do.
    """

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            refresh(batch.sparkSession, root, files_of(batch.sparkSession))

    return run


def status(snapshot: Snapshot | None, vectors_: DataFrame | None = None) -> dict[str, int]:
    """Counts of a snapshot, and of its vectors if they are given; zeros where there is no snapshot."""
    counts = {t: snapshot.tables[t].count() if snapshot else 0 for t in ("documents", "chunks")}
    return counts | ({"embedded": vectors_.count()} if vectors_ is not None else {})


def materialized(passages: DataFrame, id_: str, path: str, most: int = 0) -> dict[str, int]:
    """Passages (id, content) as a file each, in folders named after the first two letters of the encoded id.

    Those that are there already are left as they are. With ``most``, only the first so many by id. Counts of
    passages processed, written and reused.
    """
    named = passages.select(safe_name(F.col(id_)).alias("name"), "content", id_)
    named = (named.orderBy(id_).limit(most) if most > 0 else named).drop(id_).dropDuplicates(["name"])
    try:
        files = passages.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
        there = saved(files.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("name")))
        fresh = named.join(there, "name", "left_anti")
    except AnalysisException:
        fresh = named
    processed, written = named.count(), fresh.count()
    write_passages(fresh, path)
    return {"processed": processed, "written": written, "reused": processed - written}


def formatted(results: DataFrame, kind: str = "text") -> DataFrame:
    """Search results as lines of text, Markdown or JSON, or the distinct files in order."""
    if kind == "files":
        return catalog.distinct_files(results).select("query_id", "rank", F.col("file").alias("value"))
    if kind == "json":
        return results.select("query_id", "rank", F.to_json(F.struct("*")).alias("value"))
    percent = F.concat(F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("%"))
    head = F.concat(F.lit("### " if kind == "markdown" else ""), F.col("rank").cast("string"), F.lit(". "), F.col("title"), F.lit(" ("), percent, F.lit(")"))
    return results.select("query_id", "rank", F.concat_ws("\n", head, F.concat(F.col("file"), F.lit("#"), F.col("start_line").cast("string")), F.col("snippet")).alias("value"))

