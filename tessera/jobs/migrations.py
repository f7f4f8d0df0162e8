"""Steps from one schema of an index to the next, as transformations of its tables.

Schema 1 was a folder of whole snapshots: ``v<n>/documents``, ``chunks`` and ``postings``, and rows in ``meta`` that name
the complete ones. Schema 2 has segments and commits. A step reads the old tables and commits a version of the new
schema; it leaves the old ones as they are, so that a step that dies is begun again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.jobs import segments
from tessera.operators import lexical


def schema_of(spark: SparkSession, root: str) -> int | None:
    """The schema that an index is in; None where there is none. Reads only."""
    try:
        found = spark.read.schema(segments.COMMIT).json(f"{root}/commits").agg(F.max("schema_version")).first()[0]
        if found is not None:
            return found
    except AnalysisException:
        pass
    try:
        return spark.read.parquet(f"{root}/meta").orderBy(F.col("version").desc()).first()["schema_version"]
    except (AnalysisException, TypeError):
        return None


def snapshot_to_segments(spark: SparkSession, root: str) -> None:
    """The last snapshot becomes the first segment; its version goes on counting."""
    row = spark.read.parquet(f"{root}/meta").orderBy(F.col("version").desc()).first()
    at = f"{root}/v{row['version']}"
    documents, chunks = spark.read.parquet(f"{at}/documents"), spark.read.parquet(f"{at}/chunks")
    stamped = chunks.groupBy("doc_id").agg(F.max("indexed_in").alias("indexed_in"))
    notes = documents.join(stamped, "doc_id", "left").withColumns({
        "indexed_in": F.coalesce("indexed_in", F.lit(row["version"])), "noted_in": F.lit(row["version"]), "removed": F.lit(False),
    })
    whole = lexical.analyzed(chunks.drop("dl"), kept=[c for c in chunks.columns if c not in ("dl", "embedding_content")])
    characters = chunks.agg(F.sum(F.length("content"))).first()[0] or 0
    segment = segments.written(spark, root, notes, whole, segments.BUCKETS, characters)
    segments.committed(spark, root, row["version"], (segment,), segments.BUCKETS, row["created_at"])


#: By the schema that a step begins with.
STEPS: dict[int, Callable[[SparkSession, str], None]] = {1: snapshot_to_segments}


def migrated(spark: SparkSession, root: str) -> list[int]:
    """Take the steps that an index needs to be of this library's schema; the schemas that they began with."""
    taken = []
    while (at := schema_of(spark, root)) is not None and at < segments.SCHEMA_VERSION:
        STEPS[at](spark, root)
        taken.append(at)
    return taken
