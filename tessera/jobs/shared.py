"""The given tables, and the index of all documents that the registered queries of a session share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import title_of
from tessera.jobs import segments
from tessera.jobs.indexing import indexed_chunks
from tessera.operators.scratch import new_path

_built: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def path_of() -> Column:
    return F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def shared_index(spark: SparkSession, sf_dir: str) -> segments.Snapshot:
    """The index of all documents under their own ids, built once for each session and state of the table's files."""
    docs = documents(spark, sf_dir)
    files = docs.select(*[F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_modification_time", "file_size")]).groupBy("file_path", "file_modification_time", "file_size")
    state = files.agg(F.count(F.lit(1)).alias("rows")).agg(F.sum(F.xxhash64("*").cast("decimal(20,0)")).cast("string")).first()[0]
    key = (spark.sparkContext.applicationId, sf_dir, str(state))
    if key not in _built:
        root = new_path(spark)
        chunks = indexed_chunks(docs.select("doc_id", F.col("text").alias("content"), F.lit(False).alias("markdown")), 1)
        notes = docs.select(
            "doc_id", F.col("source").alias("collection"), path_of().alias("path"), title_of(F.col("text"), path_of()).alias("title"), F.col("n_chars").cast("double").alias("mtime"),
            F.sha1("text").alias("hash"), F.lit(0).cast("long").alias("indexed_at"), F.lit(1).alias("indexed_in"), F.lit(1).alias("noted_in"), F.lit(False).alias("removed"),
        )
        characters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        segment = segments.written(spark, root, notes, chunks, segments.BUCKETS, characters)
        segments.committed(spark, root, 1, (segment,), segments.BUCKETS, 0)
        _built[key] = root
    return segments.current(spark, _built[key])
