"""From raw documents to packed training sequences: five stages, each a table.

A stage takes all its predecessor kept and returns the columns of ``documents``; the last returns pieces of
sequences with their token ids. Stages are written as Parquet in the shared checkpoint folder and read again,
so that a lost executor costs a stage's task at most; a stage's own intermediate tables go when it is written.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, near_dedup, packing, pii, quality_rules
from tessera.llm.common import settled, table


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, likeness of 0.8 or more."""
    return near_dedup.deduplicated(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in angle brackets."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's target weight asks for, or not at all."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Hashed evidence, fields and windows can't be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = functools.partial(stage, spark, docs, sf_dir)
        docs = made() if name == STAGES[-1][0] else settled(spark, made)
    return docs
