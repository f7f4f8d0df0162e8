"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import merkle
from tessera.llm.common import sealed, table
from tessera.llm.contract_sql import MANIFEST_SQL, RANKED_SQL, SHARDED_SQL
from tessera.llm.fingerprints import fingerprints
from tessera.llm.html_text import extracted
from tessera.llm.mixing import MIXTURE_SQL, mixture
from tessera.llm.near_dedup import Settings as NearSettings
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import packed
from tessera.llm.pii import found
from tessera.llm.quality_classifier import classified
from tessera.llm.quality_rules import judged
from tessera.llm.ranked_search import ranked
from tessera.llm.sharding import sharded
from tessera.llm.toxicity import scored, trained
from tessera.llm.url_filter import judged_urls, labelled_table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), with_ids=False)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(table(spark, sf_dir, "pages"), labelled_table(spark))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its host, and its language the section that its path begins with."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    return classified(docs, table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearSettings(shingle=2))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and what becomes of the root where a row's n_chars was tampered with."""
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    row = lambda n_chars: merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.when(chosen & F.col("n_chars").isNotNull(), row(F.col("n_chars") + 1))
    made = merkle.manifest(docs, carried={"tampered": tampered})
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = made.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return sealed(out.withColumn("verified", F.col("folded_root") == F.col("root")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_html_text": op2_html_text,
    "op3_packing": op3_packing,
    "op4_mixing": op4_mixing,
    "op5_url_filter": op5_url_filter,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_pii": op7_pii,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_ranked_search": op12_ranked_search,
    "op13_sharding": op13_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": MIXTURE_SQL,
    "op11_merkle_manifest": MANIFEST_SQL,
    "op12_ranked_search": RANKED_SQL,
    "op13_sharding": SHARDED_SQL,
}
