"""Ranked lexical search over all documents by NRA: sorted reads alone, and score intervals until all is resolved.

The index is one of segments, the documents of about so many bytes of text in the order they are read: terms, the
documents that hold each, and how often. A segment is searched on its own: the lists of an item's terms, put in the
order of their impact, are read from the top in growing blocks. A document's lower bound is what was read of it; its
upper bound adds, for each list it wasn't read in, the highest impact still unread there. Reading ends when no
document that could be among the best has an open interval; that settles members, ties and scores. Documents that
can't reach the best of the segments before (in the same task) count as settled too.

A segment lives in the task that reads its documents, one at a time, and is made twice: to count, and to search.
Postings are never rows: a row of some MB, thousands of which Spark puts into one batch for Python, would let a
task's memory grow with its share of the input. No list is one task's: a term that every document holds has a list
in each segment. What leaves a task is counts, and the best of its segments for each item. Items are searched in
blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, saved

#: What separates terms: every ASCII character that is neither a digit nor a letter.
NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands for a null id.
NO_ID = np.iinfo(np.int64).min
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text in a segment; a longer document is a segment of its own.
SEGMENT_BYTES = 1 << 22
#: Postings of each list in the first read; every later one takes as many as were read.
FIRST_READ = 256
#: Pairs of item and term in a block of items, about (some 2.5 MB), and blocks that one pass over the documents broadcasts.
PAIRS_IN_BLOCK, BLOCKS_IN_PASS = 1 << 16, 4
FOUND = "item_id long, doc_id long, score long"


def _segment(ids: pa.Array, texts: pa.Array) -> dict:
    """The index of some documents: postings by term, then by document."""
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), NOT_TERM)
    flat, owner = split.flatten(), pc.list_parent_indices(split)
    real = pc.not_equal(flat, "")
    coded = flat.filter(real).dictionary_encode()
    owner = owner.filter(real).to_numpy().astype(np.int64)
    postings, tfs = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + owner, return_counts=True)
    dfs = np.bincount(postings // max(len(ids), 1), minlength=len(coded.dictionary))
    return {"ids": ids, "lengths": np.bincount(owner, minlength=len(ids)), "terms": coded.dictionary.cast(pa.string()), "dfs": dfs,
            "docs": postings % max(len(ids), 1), "tfs": tfs}


def segments(batches: Iterator[pa.RecordBatch], segment_bytes: int) -> Iterator[dict]:
    """The index of all documents (key, whole text) of a task, one segment after the other; null text has no term."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, upto = 0, np.cumsum(sizes)
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] - sizes[at] + segment_bytes, "right")))
            yield _segment(ids.slice(at, end - at), texts.slice(at, end - at))
            at = end


def counted(docs: DataFrame, segment_bytes: int) -> DataFrame:
    """term, df, tokens: for each segment the documents that hold a term; of the empty term, those with any, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment in segments(batches, segment_bytes):
            terms = pa.concat_arrays([pa.array([""]), segment["terms"]])
            df = np.r_[np.count_nonzero(segment["lengths"]), segment["dfs"]].astype(np.int64)
            tokens = np.r_[segment["lengths"].sum(), np.zeros(len(df) - 1)].astype(np.int64)
            yield pa.RecordBatch.from_arrays([terms, pa.array(df), pa.array(tokens)], names=["term", "df", "tokens"])

    return docs.mapInArrow(run, "term string, df long, tokens long")


def asked(items: DataFrame, docs: DataFrame, key: str, text: str, in_block: int, segment_bytes: int) -> tuple[DataFrame, int, int]:
    """One row for each block of items (block, q_items, q_terms, q_weights), a place for each item and term; weights of 0 are left out.

    With it, the number of documents with a term, and of all their terms.
    """
    terms = F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), NOT_TERM), "")
    each = saved(items.select(F.col(key).cast("long").alias("item_id"), F.explode(terms).alias("term")).distinct())
    blocks = max(1, -(-each.count() // in_block))
    wanted = saved(each.select("term").unionAll(items.sparkSession.range(1).select(F.lit("").alias("term"))).distinct())
    held = counted(docs, segment_bytes).join(broadcast_if_small(wanted), "term", "left_semi")
    df = saved(held.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens")))
    whole = df.where("term = ''").first()
    documents, tokens = (whole["df"], max(whole["tokens"], 1)) if whole else (0, 1)
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = each.join(df.drop("tokens"), "term").withColumn("weight", weight).where("weight > 0")
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    packed = weighed.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("item_id", "term", "weight"))).alias("q"))
    return packed.select("block", F.col("q.item_id").alias("q_items"), F.col("q.term").alias("q_terms"), F.col("q.weight").alias("q_weights")), documents, tokens


def nra(docs: list[np.ndarray], impacts: list[np.ndarray], documents: int, limit: int, least: int = 0, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the best, and of all others as good as the last of them, at least ``least`` and above 0.

    The lists (documents, impacts) fall in impact. Only the next block of each list is read at a time.
    """
    lists = range(len(docs))
    frontier = np.array([i[0] if len(i) else 0 for i in impacts], np.int64)
    seen_docs, seen_of, lower, start, width = [], [], np.zeros(documents), 0, first_read
    while frontier.any():
        parts = [t for t in lists if start < len(docs[t])]
        read = [docs[t][start : start + width] for t in parts]
        lower += np.bincount(np.concatenate(read), np.concatenate([impacts[t][start : start + width] for t in parts]), documents)
        seen_docs += read
        seen_of += [np.full(len(r), t) for r, t in zip(read, parts, strict=True)]
        start, width = start + width, start + width
        frontier = np.array([i[start] if start < len(i) else 0 for i in impacts], np.int64)
        if not frontier.any():
            break
        known = np.bincount(np.concatenate(seen_docs), frontier[np.concatenate(seen_of)], documents)
        upper = lower + (frontier.sum() - known)
        kth = max(least, np.partition(lower, -limit)[-limit] if documents >= limit else 0, 1)
        if not ((upper >= kth) & (upper > lower)).any():
            break
    kth = max(least, np.partition(lower, -limit)[-limit] if documents >= limit else 0, 1)
    best = np.flatnonzero(lower >= kth)
    return best, lower[best].astype(np.int64)


def _lists(segment: dict, terms: pa.Array, weights: np.ndarray, documents: int, tokens: int) -> tuple[list, list]:
    """The lists of some terms of a segment, in the order of their impact."""
    ends = np.cumsum(segment["dfs"])
    where = pc.index_in(terms, value_set=segment["terms"]).to_numpy(zero_copy_only=False)
    docs, impacts = [], []
    m = 10 + (90 * segment["lengths"].astype(np.int64) * documents) // tokens
    for at, w in zip(where, weights, strict=True):
        if np.isnan(at):
            docs.append(np.zeros(0, np.int64))
            impacts.append(np.zeros(0, np.int64))
            continue
        end = ends[int(at)]
        span = slice(end - segment["dfs"][int(at)], end)
        d, tf = segment["docs"][span], segment["tfs"][span].astype(np.int64)
        impact = w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[d]))
        order = np.argsort(-impact, kind="stable")
        docs.append(d[order])
        impacts.append(impact[order])
    return docs, impacts


def _found(block: dict, segment: dict, best: dict[int, list[tuple[int, int]]], documents: int, tokens: int, limit: int) -> None:
    """Adds to the best documents of each item of a block those of a segment."""
    lists, impacts = _lists(segment, block["terms"], block["weights"], documents, tokens)
    bounds = block["bounds"]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        item, mine = int(block["items"][a]), block["codes"][a:b]
        had = best.get(item, [])
        found, scores = nra([lists[c] for c in mine], [impacts[c] for c in mine], len(segment["ids"]), limit, -had[-1][0] if len(had) == limit else 0)
        if len(found):
            named = segment["ids"].take(pa.array(found)).to_pylist()
            more = [(-int(s), NO_ID if i is None else i) for i, s in zip(named, scores, strict=True)]
            best[item] = sorted(had + more)[:limit]


def _block(row: dict) -> dict:
    """A block of items as the search reads it: its terms with their weights, and the codes of each item's terms."""
    items = pc.fill_null(row["q_items"].values, NO_ID).to_numpy()
    terms = row["q_terms"].values.dictionary_encode()
    codes = terms.indices.to_numpy()
    weights = np.zeros(len(terms.dictionary), np.int64)
    weights[codes] = row["q_weights"].values.to_numpy()
    return {"items": items, "terms": terms.dictionary, "codes": codes, "weights": weights, "bounds": np.flatnonzero(np.r_[True, items[1:] != items[:-1], True])}


def ranked(items: DataFrame, docs: DataFrame, limit: int = 10, key: str = "item_id", text: str = "text", in_block: int = PAIRS_IN_BLOCK, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``limit`` best documents of each item with a score above 0, by score, then by id (null first).

    Null and empty texts have no terms, and an item without any has no rows. Items of one id are one item with the
    terms of all; documents of one id are documents of their own. Empty tables give an empty result; extra columns
    are ignored.
    """
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), F.col("text"))
    packed, documents, tokens = asked(items, docs, key, text, in_block, segment_bytes)
    blocks = saved(packed)

    def passed(some: list[int]) -> DataFrame:
        """The best of each task for the items of some blocks."""
        shared = spark.sparkContext.broadcast(blocks.where(F.col("block").isin(some)).toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked_ = shared.value
            mine = [_block({c: asked_.column(c)[row] for c in asked_.column_names}) for row in range(asked_.num_rows)]
            best: dict[int, list[tuple[int, int]]] = {}
            for segment in segments(batches, segment_bytes):
                for block in mine:
                    _found(block, segment, best, documents, tokens, limit)
            rows = [(i, d, -s) for i, found in best.items() for s, d in found]
            columns = [pa.array([None if v == NO_ID and c < 2 else v for v in col], pa.int64()) for c, col in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

        return docs.mapInArrow(run, FOUND)

    # every segment meets every block of items; a pass's blocks are bounded, and so are broadcast
    numbers = sorted(r["block"] for r in blocks.select("block").collect())
    passes = [passed(numbers[at : at + BLOCKS_IN_PASS]) for at in range(0, len(numbers), BLOCKS_IN_PASS)]
    scored = reduce(DataFrame.unionAll, passes) if passes else spark.createDataFrame([], FOUND)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return scored.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= limit).select("item_id", "rank", "doc_id", "score")
