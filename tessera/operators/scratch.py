"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as the session names it.

    Where it is unset, a local session gets one below its warehouse; on a cluster that is an error, since a
    folder of one machine would not be seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Paths of the tables saved since each open call of ``settled``.
_made: list[list[str]] = []


def new_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    for paths in _made:
        paths.append(path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it back.

    The table is columnar, so that later readers prune columns, and it outlives lost executors.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """The tables that are saved within are deleted at its end: nothing that is read after it may be of them."""
    paths: list[str] = []
    _made.append(paths)
    try:
        yield
    finally:
        _made.remove(paths)
        for path in paths:
            deleted(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, as a saved table; the tables saved on its way go once it is written."""
    paths: list[str] = []
    _made.append(paths)
    try:
        out = saved(make())
    finally:
        _made.pop()
    for path in paths[:-1]:
        deleted(spark, path)
    return out


#: Rows and bytes that are broadcast at most.
MOST_ROWS, MOST_BYTES = 250_000, 64 << 20


def broadcast_if_small(df: DataFrame, most_rows: int = MOST_ROWS, rows: int | None = None, width: Column | None = None) -> DataFrame:
    """With a broadcast hint if a count shows the rows to be few; else a merge join, which any size can go through.

    For slim rows: ids, scores, terms, names; never for texts. Where rows are wide, ``width`` says how many bytes one
    has, and their sum counts too. ``rows`` is their number, or a bound of it, where that is known already.
    """
    if width is not None:
        found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).first()
        few = found["n"] <= most_rows and (found["bytes"] or 0) <= MOST_BYTES
    else:
        few = (df.count() if rows is None else rows) <= most_rows
    return F.broadcast(df) if few else df.hint("merge")
