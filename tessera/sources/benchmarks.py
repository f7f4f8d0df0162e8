"""Readers and writers of retrieval-benchmark files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.evaluation import trec_line


def topics(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query from lines ``id TAB text``."""
    t = F.split("value", "\t", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(t[0].alias("query_id"), t[1].alias("query"))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance from four columns (query, iteration, document, relevance) or three with a header.

    A line of any other width fails the job.
    """
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(f.alias("f")).where(F.col("f")[0] != "query-id")
    doc = F.when(F.size("f") == 4, F.get("f", F.lit(2))).when(F.size("f") == 3, F.get("f", F.lit(1)))
    doc = F.coalesce(doc, F.raise_error(F.lit("a judgement has three or four columns")).cast("string"))
    return rows.select(F.col("f")[0].alias("query_id"), doc.alias("doc_id"), F.element_at("f", -1).cast("int").alias("relevance"))


def corpus(spark: SparkSession, path: str, id_: str = "_id") -> DataFrame:
    """doc_id, content from JSON lines (plain or gzipped): title and text, a blank line between."""
    rows = spark.read.schema(f"`{id_}` string, title string, text string").json(path)
    return rows.select(F.col(id_).alias("doc_id"), passage_text(F.col("title"), F.col("text")).alias("content"))


def topics_with_judgements(topics_: DataFrame, judgements_: DataFrame, order: str, most: int = 0) -> DataFrame:
    """The topics that have a judgement; with ``most``, the first so many in their order."""
    some = topics_.join(judgements_.select("query_id"), "query_id", "left_semi")
    return some.orderBy(order).limit(most) if most > 0 else some


def judgements_of(judgements_: DataFrame, topics_: DataFrame) -> DataFrame:
    return judgements_.join(topics_.select("query_id"), "query_id", "left_semi")


def natural_order(path: Column) -> Column:
    """Sort key of corpus files: by the number in their name, others last by name."""
    number = F.try_to_number(F.nullif(F.regexp_extract(path, r"docs-(\d+)\.jsonl\.gz$", 1), F.lit("")), F.lit("9" * 18))
    return F.struct(F.coalesce(number.cast("long"), F.lit((1 << 63) - 1)).alias("number"), path.alias("path"))


def passage_text(title: Column, text: Column) -> Column:
    """Title and text, trimmed, a blank line between, a newline at the end."""
    parts = [F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in (title, text)]
    return F.concat(F.concat_ws("\n\n", *parts), F.lit("\n"))


def run_lines(results: DataFrame, name: str) -> DataFrame:
    return results.select(trec_line(F.col("query_id"), F.col("doc_id"), F.col("rank"), F.col("score"), name).alias("value"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, rank, score, name; lines of six fields."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(
        f[0].alias("query_id"), f[2].alias("doc_id"), f[3].cast("int").alias("rank"), f[4].cast("double").alias("score"), f[5].alias("name")
    )
