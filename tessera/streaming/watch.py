"""A stream of file changes: debounced per path, then applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: What a change does: ``unlink`` removes, others index.
REMOVES = "unlink"


def debounced(events: DataFrame, quiet: str = "500 milliseconds", late: str | None = "10 minutes") -> DataFrame:
    """One row per path and burst (path, opened, closed, op, changes) of events (path, op, ts).

    A burst ends when a path is quiet for the gap; its last event counts. On a stream the watermark bounds
    the state that is kept for late events; in batch it means nothing.
    """
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    return (
        rows.groupBy("path", F.session_window("ts", quiet).alias("burst"))
        .agg(F.max_by("op", F.struct("ts", "op")).alias("op"), F.count(F.lit(1)).alias("changes"))
        .select("path", F.col("burst.start").alias("opened"), F.col("burst.end").alias("closed"), "op", "changes")
    )


def owner(path: Column, roots: list[tuple[str, str]]) -> Column:
    """The first collection whose root holds the path; the root is a whole folder name."""
    found = F.lit(None).cast("string")
    for name, root in reversed(roots):
        found = F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.lit(name)).otherwise(found)
    return found


def sent(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, quiet: str = "500 milliseconds", every: str | None = None, late: str | None = None) -> StreamingQuery:
    """Run a stream of change events (path, op, ts) through the debouncing into ``sink(bursts, batch)``.

    Without ``every`` all that is there is taken and the stream ends; with it (a time like ``5 minutes``) the
    stream looks again at that pace. For a replay (no ``late``) each batch brings all bursts so far, so that a sink
    that replaces its state needs no more than the last one, and one that is run again does no harm. With
    ``late`` (a time) each burst comes once, when the watermark has passed it, and state is kept no longer.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return debounced(events, quiet, late).writeStream.outputMode("append" if late else "complete").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def clocked(spark: SparkSession, look: Callable[[SparkSession], object], checkpoint: str, every: str = "5 minutes") -> StreamingQuery:
    """Call ``look`` at a pace: listings and registries aren't streams, so a clock asks for their difference each time.

    A look compares what is there with what is stored and applies the difference; one that is late or repeated
    finds less, or nothing, to do. Looks never overlap: a batch begins when the one before is done.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, _: look(batch.sparkSession)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def latest_state(bursts: DataFrame) -> DataFrame:
    """path, op, closed of each path's last burst."""
    return bursts.groupBy("path").agg(F.max_by(F.struct("op", "closed"), F.struct("closed", "op")).alias("l")).select("path", "l.op", "l.closed")


def applied(stored: DataFrame, changes: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The documents after a batch of changes (path, op): removed and changed ones go, and changed ones are read anew.

    Applying a batch twice gives the same table, so that a restarted stream does no harm.
    """
    rest = stored.join(changes.select("path"), "path", "left_anti")
    return rest.unionByName(read(changes.where(F.col("op") != REMOVES).select("path")).select(stored.columns))
