"""A stream with a watermark: each burst comes once, and state doesn't stay."""

from pyspark.sql import functions as F

from tessera.streaming.watch import sent


def test_closed_bursts_come_once(spark, tmp_path):
    rows = [("/a", "change", 0), ("/a", "unlink", 10), ("/b", "change", 5), ("/a", "change", 400), ("/z", "change", 100_000)]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "path string, op string, s long").coalesce(1).write.mode("append").parquet(str(tmp_path / "events" / str(i)))
    got = []
    for i in range(2):
        source = spark.readStream.schema("path string, op string, s long").parquet(str(tmp_path / "events" / "[0-1]" if i else tmp_path / "events" / "0"))
        events = source.select("path", "op", F.timestamp_seconds("s").alias("ts"))
        query = sent(events, lambda bursts, _: got.extend(tuple(r) for r in bursts.select("path", "op", "changes").collect()), str(tmp_path / f"cp{i}"), "1 minute", late="1 minute")
        query.awaitTermination(120)
    assert sorted(got) == [("/a", "change", 1), ("/a", "unlink", 2), ("/b", "change", 1)]
