"""Answers on a stream expire by event time."""

from pyspark.sql import functions as F

from tessera.streaming.cache import kept


def test_answers_are_replaced_and_expire(spark, tmp_path):
    batches = [[("a", "one", 0), ("a", "two", 20), ("b", "x", 10)], [("b", "y", 50)], [("z", "late", 2000)], [("z", "later", 2100)]]
    got, folder = [], tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "cache_key string, response string, s long").coalesce(1).write.mode("append").parquet(str(folder / f"p={i}"))
        stream = spark.readStream.schema("cache_key string, response string, s long, p int").parquet(str(folder))
        entries = stream.select("cache_key", "response", F.timestamp_seconds("s").alias("ts"))
        query = (
            kept(entries, ttl=100, late="10 seconds").writeStream.outputMode("append")
            .foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        assert query.exception() is None
    puts = [g for g in got if g[1] == "put"]
    assert ("a", "put", "two") in puts and ("b", "put", "x") in puts and ("b", "put", "y") in puts and ("a", "put", "one") not in puts
    assert sorted(g for g in got if g[1] == "expired") == [("a", "expired", "two"), ("b", "expired", "y")]
