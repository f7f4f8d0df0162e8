"""Dealing documents into shards of near equal size, equal texts together.

Longest processing time first: groups that must stay together go by falling size to the least loaded shard, which
a heap names. Groups are as many as texts, so the heap doesn't meet them one by one: groups of one size are
interchangeable, and are dealt in rounds over the shards that are behind, as the heap would deal them one after
another. The heap meets a row for each size: a size counts with its 16 leading bits, which is exact below 65,536
and low by a 32,768th at most above, so that there are 65,536 sizes and then 32,768 for each doubling at most (some
650,000 for 100 TB, since large groups are few). Those rows alone come to the driver. Which group of a size
comes when, and a row's slot in its shard, are places in sorts that Spark makes in ranges.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import placed_within, saved

SHARDS = 24
#: Leading bits of a group's size that count.
SIZE_BITS = 16
#: Bytes that a row costs besides its text.
ROW_BYTES = 8
#: A group of more than one row in so many is broadcast: there are fewer such groups than this.
HOT_SHARE = 4096


def leading(size: Column, bits: int = SIZE_BITS) -> Column:
    """A size without the bits after its leading ones."""
    past = F.greatest(F.length(F.bin(size)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, past), past)


def dealt(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int], list[list[int]]]]:
    """How the heap deals groups: (size, firsts, cycles) for classes (size, groups) by falling size.

    The groups of a class from ``firsts[i]`` on go round the shards of ``cycles[i]``. A round takes the shards
    that get a group before any of them gets its second, and is repeated until another shard is behind them.
    """
    heap = [(0, i) for i in range(shards)]
    for size, n in classes:
        firsts, cycles, at = [], [], 0
        while at < n:
            least, turn = heap[0], []
            while heap and len(turn) < n - at and heap[0] < (least[0] + size, least[1]):
                turn.append(heapq.heappop(heap))
            rounds = (n - at) // len(turn)
            if heap:
                gap = heap[0][0] - turn[-1][0]
                ahead = -(-gap // size) + (gap % size == 0 and turn[-1][1] < heap[0][1])
                rounds = min(rounds, max(1, ahead))
            firsts.append(at)
            cycles.append([i for _, i in turn])
            at += rounds * len(turn)
            for load, i in turn:
                heapq.heappush(heap, (load + rounds * size, i))
        yield size, firsts, cycles


def _shard_of_groups(groups: DataFrame, shards: int) -> DataFrame:
    """digest, copies, shard for groups (digest, copies, weight)."""
    spark = groups.sparkSession
    counted = groups.groupBy("weight").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("weight", ascending=False)
    plan = list(dealt(zip(counted["weight"].tolist(), counted["n"].tolist(), strict=True), shards))
    kinds = [("weight", pa.int64()), ("firsts", pa.list_(pa.int64())), ("cycles", pa.list_(pa.list_(pa.int16())))]
    table = pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, zip(*plan, strict=True) if plan else ([], [], []), strict=True)})
    ranked = placed_within(groups, "weight", ["digest"], "place")
    # bounded as the sizes are, and a size's cycles hold 300 shards at most
    met = ranked.join(F.broadcast(saved(spark.createDataFrame(table))), "weight")
    run = F.size(F.filter("firsts", lambda f: f <= F.col("place"))) - 1
    met = met.withColumn("run", run).withColumn("cycle", F.get("cycles", F.col("run")))
    step = (F.col("place") - F.get("firsts", F.col("run"))) % F.size("cycle")
    return saved(met.select("digest", "copies", F.get("cycle", step.cast("int")).cast("int").alias("shard")))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _with_shards(rows: DataFrame, sized: DataFrame, shards: int) -> DataFrame:
    """``rows`` (with a digest) and their shard; ``sized`` (digest, size) are the rows that the shards are made for."""
    summed = sized.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("total"))
    placed = _shard_of_groups(saved(summed.select("digest", "copies", leading(F.col("total")).alias("weight"))), shards)
    hot = F.col("copies") * HOT_SHARE > sized.count()
    common = F.broadcast(placed.where(hot).select("digest", "shard"))
    rest = rows.join(common.select("digest"), "digest", "left_anti").join(placed.where(~hot).select("digest", "shard"), "digest")
    return rows.join(common, "digest").unionByName(rest)


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row in one shard, equal texts in the same one.

    Size is the text's bytes in UTF-8 and 8 more. Null and empty texts are equal. Rows of equal or null ids
    are all kept; slots run from 0 in each shard by id (null first), checksum and place of reading. A group larger
    than a shard's share has a shard of its own, and the others are even as far as it lets them. An empty table
    gives an empty result; extra columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sized = saved(docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), _digest(F.col(text)).alias("digest"),
    ))
    found = _with_shards(sized, sized.select("digest", "size"), shards).drop("digest")
    return placed_within(saved(found), "shard", ["doc_id", "text_crc32"], "slot")


def written(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 8) -> None:
    """Write the documents into a folder for each shard (``shard=0`` ...), dealt by their ids into ``files`` files.

    So a shard is as many tasks, and a text is shuffled once. Rows of one id lie in one file.
    """
    sized = saved(docs.select(_digest(F.col("text")).alias("digest"), (F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES).cast("long").alias("size")))
    met = _with_shards(docs.withColumn("digest", _digest(F.col("text"))), sized, shards).drop("digest")
    cut = F.pmod(F.xxhash64("doc_id"), F.lit(files))
    met.repartition(shards * files, "shard", cut).write.mode("overwrite").partitionBy("shard").parquet(path)
