"""Text files under a collection's root."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.codecs import relative_path
from tessera.functions.text import title_of
from tessera.operators.catalog import ignored, indexable

#: What is never indexed.
ALWAYS_IGNORED = ("node_modules", ".git", "*.tmp", ".DS_Store")
#: Names of indexable files, in any case, as Spark's listing filters them.
_NAMES = "*.{[mM][dD],[mM][aA][rR][kK][dD][oO][wW][nN],[tT][xX][tT]}"
#: The longest file that Spark reads into a row, unless the session says less.
_LONGEST = (1 << 31) - 1


def listed(spark: SparkSession, root: str, ignore: tuple[str, ...] = ALWAYS_IGNORED, glob: str = "*") -> DataFrame:
    """path, relative, mtime, length of the indexable files below a root; no content is read."""
    names = _binary(spark).load(root).select("path", "modificationTime", "length")
    base = F.lit(root if "://" in root or root.startswith("file:") else f"file:{root}")
    rows = names.where(indexable(F.col("path"))).withColumn("relative", relative_path(F.col("path"), base))
    rows = rows.where(~ignored(F.col("relative"), list(ignore)))
    if glob != "*":
        rows = rows.where(F.element_at(F.split("path", "/"), -1).rlike(fnmatch.translate(glob)))
    return rows.select("path", "relative", (F.unix_millis("modificationTime") / 1.0).alias("mtime"), "length")


def _binary(spark: SparkSession):
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _NAMES)


def markdown(path: Column) -> Column:
    return path.rlike(r"(?i)\.(md|markdown)$")


def files(spark: SparkSession, root: str, collection: str, ignore: tuple[str, ...] = ALWAYS_IGNORED, glob: str = "*") -> DataFrame:
    """collection, path, relative, mtime, content, hash, title, markdown, error of the indexable files below a root.

    Spark lists names by their endings, so that no other file is opened, however large. Names and contents are
    read apart: a file that is listed but can't be read stays, with an error and no content, and so does one that is
    longer than a row can be, which isn't opened. Bytes that aren't UTF-8 are replaced. Spark's listing passes over
    names that begin with a dot or an underscore.
    """
    longest = min(int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(_LONGEST))), _LONGEST)
    quiet = _binary(spark).option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    read = quiet.load(root).where(F.col("length") <= longest).select("path", "content")
    text = F.decode("content", "UTF-8")
    failed = F.when(F.col("length") > longest, F.lit("too long")).when(F.col("content").isNull(), F.lit("unreadable"))
    return listed(spark, root, ignore, glob).join(read, "path", "left").select(
        F.lit(collection).alias("collection"), "path", "relative", "mtime", text.alias("content"), F.sha1("content").alias("hash"),
        title_of(text, F.col("path")).alias("title"), markdown(F.col("path")).alias("markdown"), failed.alias("error"),
    )
