"""The state of cached answers is held in buckets of keys, and each key is put and expires as if it had a state of its own."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessera.streaming.cache import BUCKETS, kept

TTL, LATE = 100, 10


def streamed(spark, tmp_path, batches, **options):
    """The rows of a stream that is taken up again for each batch of (cache_key, response, micros), and the rows of its state."""
    got, folder, held = [], tmp_path / "in", []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "cache_key string, response string, micros long").coalesce(1).write.mode("append").parquet(str(folder / f"p={i}"))
        entries = spark.readStream.schema("cache_key string, response string, micros long, p int").parquet(str(folder)).select("cache_key", "response", F.timestamp_micros("micros").alias("ts"))
        query = (
            kept(entries, ttl=TTL, late=f"{LATE} seconds", **options).writeStream.outputMode("append")
            .foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination(180)
        assert query.exception() is None
        held += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return got, held


def by_key(batches):
    """What a state for each key says: the latest answer, the greatest of one time, is put in each batch that has the key; it expires once the watermark is past its time."""
    state, out, newest = {}, [], 0
    for rows in batches:
        for key, response, micros in rows:
            state[key] = max(state.get(key, (0, False, "")), (micros, response is None, response or ""))
        told = lambda key, event: (key, event, None if state[key][1] else state[key][2])
        out += [told(key, "put") for key in {r[0] for r in rows}]
        newest = max(newest, *(r[2] for r in rows))
        gone = [key for key, (micros, *_) in state.items() if micros // 1000 + TTL * 1000 < newest // 1000 - LATE * 1000]
        out += [told(key, "expired") for key in gone]
        for key in gone:
            del state[key]
    return out


def answers(draw, keys, n, seconds):
    """Random answers in batches, many of one time, none later than the watermark allows."""
    times = [sorted(draw.randrange(low * 4, (low + 40) * 4) * 250_000 + draw.choice((0, 1)) for _ in range(n)) for low in seconds]
    return [[(draw.choice(keys), draw.choice(["x", "y", "z", "", None]), micros) for micros in batch] for batch in times]


def in_order(rows):
    return sorted(rows, key=str)


def test_keys_of_a_bucket_are_put_and_expire_on_their_own(spark, tmp_path):
    batches = answers(random.Random(5), [*(f"k{i}" for i in range(40)), None], 30, (1000, 1035, 1080, 1140, 1300, 1330))
    got, held = streamed(spark, tmp_path, batches, buckets=3)
    assert in_order(got) == in_order(by_key(batches)) and {r[1] for r in got} == {"put", "expired"}
    assert max(held) <= 3


def test_state_has_a_row_for_a_bucket_and_not_for_a_key(spark, tmp_path):
    first = [(f"k{i}", str(i), 1_000_000_000 + i) for i in range(2000)]
    batches = [first, [(f"k{i}", "anew", 1_060_000_000) for i in range(0, 2000, 4)], [("end", "", 1_150_000_000)]]
    got, held = streamed(spark, tmp_path, batches)
    assert in_order(got) == in_order(by_key(batches)) and len(got) == 2000 + 500 + 1 + 1500
    assert max(held) <= BUCKETS


def test_one_time_in_two_batches_keeps_the_greatest_answer(spark, tmp_path):
    batches = [[("a", "two", 1_000_000_000)], [("a", "one", 1_000_000_000)]]
    assert streamed(spark, tmp_path, batches)[0] == [("a", "put", "two")] * 2


def test_an_answer_without_time_is_an_error(spark, tmp_path):
    with pytest.raises(StreamingQueryException, match="an answer has no time"):
        streamed(spark, tmp_path, [[("a", "one", None), ("a", "two", 1_000_000_000)]])
