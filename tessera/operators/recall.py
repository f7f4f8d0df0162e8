"""Proactive recall: which prompts ask for earlier notes, with which query, and what fits the context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import compact
from tessera.operators.search import Corpus, Options, search

# The wording that decides.
ASKS = (
    "之前|以前|记得|记录过|说过|提到过|决定过|偏好|喜好|待办|架构设计决策|架构决策",
    r"(?i)\bremember(ed)?\b",
    r"(?i)\bprevious(ly)?\b",
    r"(?i)\bbefore\b",
    r"(?i)\bearlier\b",
    r"(?i)\bdecid(e|ed)\b",
    r"(?i)\bwe decided\b",
    r"(?i)\bpreferences?\b",
    r"(?i)\btodos?\b",
    r"(?i)\bwhat did (i|we) say\b",
    r"(?i)\bsearch (my|our) (memory|notes)\b",
)
SKIPS = (r"(?i)^memory_search\s*\(", r"(?i)^memory_get\s*\(", r"(?i)^HEARTBEAT_OK$", r"(?i)^Read HEARTBEAT\.md\b")
PLAIN_ASKS = "之前|以前|记得|记录过|说过|提到过|决定过"
CJK = "[㐀-鿿぀-ヿ가-힯]"
HEADER = (
    "Earlier notes that match:\nUse them only where they bear on the question. For more of one, open its path.\n"
)


def normalized(prompt: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(prompt, F.lit("")), r"^[\s\-*]+", ""), r"\s+", " "))


def decision(prompt: Column, trigger: Column, enabled: bool = True, min_length: int = 4, names: tuple[str, ...] = ()) -> Column:
    """Why recall runs or not; ``names`` are commands whose prompts are never questions."""
    text = normalized(prompt)
    matches = lambda patterns: reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])
    return (
        F.when(F.lit(not enabled), "disabled")
        .when((F.coalesce(trigger, F.lit("")) != "") & (trigger != "user"), "non_user_trigger")
        .when(F.length(text) < min_length, "prompt_too_short")
        .when(matches((*SKIPS, *(rf"(?i)^{n}\b" for n in names))), "explicit_memory_tool_call")
        .when(~matches(ASKS), "non_memory_prompt")
        .otherwise("memory_prompt")
    )


def query_for(prompt: Column) -> Column:
    """The search text: prompts that say so already stay, others are told to be about earlier notes."""
    text = normalized(prompt)
    return (
        F.when((text == "") | text.rlike(PLAIN_ASKS), text)
        .when(text.rlike(CJK), F.concat(F.lit("之前记录的 "), text))
        .when(F.length(text) <= 24, F.concat(F.lit("previously recorded "), text))
        .otherwise(text)
    )


def cited(snippet: Column, file: Column, start_line: Column, mode: str = "auto") -> Column:
    """The snippet with where it comes from below, unless the mode is off; the line only where one is known."""
    line = F.when(start_line > 0, F.concat(F.lit("#"), start_line.cast("string"))).otherwise("")
    return snippet if mode == "off" else F.concat(snippet, F.lit("\nSource: "), file, line)


def memory_search(queries: DataFrame, corpus: Corpus, options: Options | None = None, citations: str = "auto") -> DataFrame:
    """query_id, rank, path, content (a cited snippet), score, collection, title of the best six chunks of each query."""
    found = search(queries, corpus, options or Options(limit=6, min_score=0.0, min_result_score=0.01))
    content = cited(F.col("snippet"), F.col("file"), F.col("start_line"), citations)
    return found.select("query_id", "rank", F.col("file").alias("path"), content.alias("content"), "score", "collection", "title")


def memory_get(paths: DataFrame, documents: DataFrame, live: DataFrame) -> DataFrame:
    """path, content of what is asked for: the file as it is now (path, content), empty if it isn't indexed or is gone."""
    known = live.join(documents.select("path").distinct(), "path", "left_semi")
    return paths.select("path").distinct().join(known, "path", "left").select("path", F.coalesce("content", F.lit("")).alias("content"))


def selected(results: DataFrame, most: int = 3, min_score: float = 0.2) -> DataFrame:
    """The best result of each path, then the best paths, of (query_id, path, score, rank, ...)."""
    strong = results.where(F.col("score") >= min_score)
    by_path = Window.partitionBy("query_id", "path").orderBy(F.col("score").desc(), "rank")
    best = strong.withColumn("__r", F.row_number().over(by_path)).where("__r = 1").drop("__r", "rank")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "path")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def context(chosen: DataFrame, budget: int = 1200, header: str = HEADER) -> DataFrame:
    """query_id, context, injected: blocks in order up to the first that the budget can't hold; none: no row."""
    note = F.concat(
        F.format_string("%d. [score=%.2f] ", "rank", "score"), F.col("path"),
        F.coalesce(F.concat(F.lit(" ["), "collection", F.lit("]")), F.lit("")),
        F.coalesce(F.concat(F.lit(" — "), "title"), F.lit("")), F.lit("\n   "), compact(F.col("content")), F.lit("\n"),
    )
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    fits = chosen.withColumn("block", note).withColumn("used", F.sum(F.length("block")).over(upto) + len(header)).where(F.col("used") <= budget)
    return fits.groupBy("query_id").agg(
        F.regexp_replace(
            F.concat(F.lit(header), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), "")), r"\s+\z", ""
        ).alias("context"),
        F.count(F.lit(1)).alias("injected"),
    )
