"""The catalog: tables of collections, documents, chunks and cached responses, and changes to them.

Changes are whole new tables from old ones; nothing is updated in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INDEXED_ENDINGS = r"(?i)\.(md|markdown|txt)$"


def indexable(path: Column) -> Column:
    return path.rlike(INDEXED_ENDINGS)


def ignored(relative: Column, patterns: list[str]) -> Column:
    """Whether a path below its root is ignored: ``*.ext`` by its ending, a name by equality or as a folder."""

    def one(p: str) -> Column:
        if p.startswith("*."):
            return F.endswith(relative, F.lit(p[1:]))
        return (relative == p) | F.startswith(relative, F.lit(f"{p}/")) | F.contains(relative, F.lit(f"/{p}/"))

    return reduce(lambda a, b: a | b, [one(p) for p in patterns], F.lit(False))


def change_status(current: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Each present or stored document's status: skipped, error, mtime_only, changed, added or removed.

    ``current`` and ``stored`` have the keys, mtime and hash. The hash only counts where the time differs, and so
    does an ``error`` of ``current``, a column that it may have: what wasn't to be read can't have failed.
    """
    failed = F.col("error").isNotNull() if "error" in current.columns else F.lit(False)
    a, b = current.select(*keys, F.col("mtime").alias("m1"), F.col("hash").alias("h1"), failed.alias("failed")), stored.select(
        *keys, F.col("mtime").alias("m0"), F.col("hash").alias("h0")
    )
    a, b = a.withColumn("here", F.lit(True)), b.withColumn("known", F.lit(True))
    status = (
        F.when(F.col("here").isNull(), "removed").when(F.col("m1") == F.col("m0"), "skipped").when(F.col("failed"), "error")
        .when(F.col("known").isNull(), "added").when(F.col("h1") == F.col("h0"), "mtime_only").otherwise("changed")
    )
    return a.join(b, list(keys), "full").select(*keys, status.alias("status"))


def upserted(stored: DataFrame, changes: DataFrame, keys: list[str], id_: str, kept: list[str] = []) -> DataFrame:  # noqa: B006
    """``stored`` with the rows of ``changes`` put in by key.

    A row that was there keeps its id and the columns in ``kept``; a new one gets the next ids in the order
    of its keys. Rows that no change names stay.
    """
    columns = stored.columns
    last = stored.agg(F.coalesce(F.max(id_), F.lit(0)).alias("m")).first()["m"]
    both = changes.withColumn("__new", F.lit(True)).alias("c").join(stored.withColumn("__old", F.lit(True)).alias("s"), keys, "full")
    rows = both.select(
        *keys,
        F.col(f"s.{id_}").alias(id_),
        *[
            (F.coalesce(F.col(f"s.{c}"), F.col(f"c.{c}")) if c in kept else F.when(F.col("__new"), F.col(f"c.{c}")).otherwise(F.col(f"s.{c}"))).alias(c)
            for c in columns
            if c not in (*keys, id_)
        ],
    )
    fresh = numbered(rows.where(F.col(id_).isNull()).drop(id_), keys, id_, last).withColumn(id_, F.col(id_).cast(stored.schema[id_].dataType))
    return rows.where(F.col(id_).isNotNull()).select(columns).unionByName(fresh.select(columns))


def numbered(rows: DataFrame, keys: list[str], name: str, after: int = 0) -> DataFrame:
    """The rows with ``after`` + 1, 2, 3 ... in the order of the keys.

    Ranges of keys are numbered each on its own, after the counts of those before. Their bounds are keys drawn
    by hash, so that the passes agree; bounds and counts are as many as shuffle partitions.
    """
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    drawn = rows.select(*keys).where(F.pmod(F.xxhash64(*keys), F.lit(max(1, n // (8 * most)))) == 0).distinct().orderBy(*keys).collect()
    bounds = drawn[:: max(1, -(-len(drawn) // most))][1:]
    # structs compare as their columns sort, nulls first
    at_least = lambda r: F.struct(*keys) >= F.struct(*[F.lit(r[k]).cast(rows.schema[k].dataType).alias(k) for k in keys])
    placed = rows.withColumn("__range", reduce(lambda a, b: a + b, [at_least(r).cast("int") for r in bounds], F.lit(0)))
    counts = {r["__range"]: r["count"] for r in placed.groupBy("__range").count().collect()}
    starts = [after + sum(c for i, c in counts.items() if i < k) for k in range(len(bounds) + 1)]
    start = F.get(F.array(*[F.lit(v).cast("long") for v in starts]), F.col("__range"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return placed.withColumn(name, within + start).drop("__range")


def put(stored: DataFrame, changes: DataFrame, keys: list[str], kept: list[str] = []) -> DataFrame:  # noqa: B006
    """``stored`` with the rows of ``changes``, one for each key, in place of its own; the columns in ``kept`` stay as stored."""
    old = stored.select(*keys, *[F.col(c).alias(f"__{c}") for c in kept])
    fresh = changes.join(old, keys, "left").select(
        *[(F.coalesce(F.col(f"__{c}"), F.col(c)) if c in kept else F.col(c)).alias(c) for c in stored.columns]
    )
    return stored.join(changes.select(*keys), keys, "left_anti").select(stored.columns).unionByName(fresh)


def looked_up(asked: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a table at some keys, one for each that is asked for; nulls where there is none."""
    return asked.select(*keys).join(table, keys, "left")


def collection_removed(collections: DataFrame, tables: dict[str, DataFrame], name: str) -> tuple[DataFrame, dict[str, DataFrame], bool]:
    """The collections and tables without one collection's, and whether it was there. ``tables`` has documents among others."""
    existed = not collections.where(F.col("name") == name).isEmpty()
    return collections.where(F.col("name") != name), cascade_deleted(tables, tables["documents"].where(F.col("collection") == name)), existed


def documents_deleted(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the documents at some (collection, path); those that aren't there change nothing."""
    return cascade_deleted(tables, tables["documents"].join(gone, ["collection", "path"], "left_semi"))


def collections_changed(current: DataFrame, watched: DataFrame) -> DataFrame:
    """name, event of collections that came or went: two differences of sets."""
    added = current.join(watched.select("name"), "name", "left_anti").select("name", F.lit("collection_added").alias("event"))
    return added.unionByName(watched.join(current.select("name"), "name", "left_anti").select("name", F.lit("collection_removed").alias("event")))


def run_counters(statuses: DataFrame) -> DataFrame:
    """indexed, skipped, errors of an indexing run's statuses; a file whose time alone changed counts as indexed."""
    s = F.col("status")
    return statuses.agg(
        F.count_if(s.isin("added", "changed", "mtime_only")).alias("indexed"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "error").alias("errors")
    )


def totals(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: documents, chunks, embedded."""
    counts = [t.select(F.lit(i).alias("t")) for i, t in enumerate((documents, chunks, embeddings))]
    every = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return every.agg(*[F.count_if(F.col("t") == i).alias(n) for i, n in enumerate(("documents", "chunks", "embedded"))])


def cascade_deleted(tables: dict[str, DataFrame], gone: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without the rows of the deleted documents."""
    return {name: t.join(gone.select(key), key, "left_anti") for name, t in tables.items()}


def collection_status(collections: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per collection, also empty ones: documents, chunks and the latest indexing time.

    Chunks are counted by document before they meet the documents, so that no join multiplies rows.
    """
    per_doc = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    per_collection = (
        documents.join(per_doc, "doc_id", "left")
        .groupBy(F.col("collection").alias("name"))
        .agg(F.countDistinct("doc_id").alias("doc_count"), F.coalesce(F.sum("k"), F.lit(0)).alias("chunk_count"), F.max("indexed_at").alias("last_indexed"))
    )
    return collections.join(per_collection, "name", "left").select(
        "name", F.coalesce("doc_count", F.lit(0)).alias("doc_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "last_indexed"
    )


def latest(cache: DataFrame, key: str = "cache_key", time: str = "created_at", tie: str = "response") -> DataFrame:
    """The last entry of each key: a replaced one is gone. One aggregation, which combines before it shuffles."""
    columns = [c for c in cache.columns if c != key]
    last = F.max_by(F.struct(*columns), F.struct(time, tie))
    return cache.groupBy(key).agg(last.alias("e")).select(key, *[F.col(f"e.{c}").alias(c) for c in columns])


def alive(now: Column) -> Column:
    return F.col("created_at") + F.col("ttl_sec") > now


def distinct_files(results: DataFrame) -> DataFrame:
    """A query's files in order, each at its first rank."""
    return results.groupBy("query_id", "file").agg(F.min("rank").alias("rank"))
