"""Lines of the members of zip archives: a source with a partition for each member.

``spark.read.format("zip_lines").option("path", folder or archive)`` gives archive, member, line (from 1), value and error. Only
the archives' directories are read to plan; a task opens one member and reads it as a stream, so that members of any
size and of unequal ones are read side by side. A member or an archive that can't be read is a row with an error;
the lines before the fault stay. Options: ``members``, a pattern like ``*/corpus.jsonl`` of those to read.
"""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.sources.benchmarks import passage_text
from tessera.streaming.changes import file_system

SCHEMA = "archive string, member string, line long, value string, error string"


class Member(InputPartition):
    def __init__(self, archive: str, member: str | None, error: str | None = None) -> None:
        super().__init__((archive, member))
        self.archive, self.member, self.error = archive, member, error


class ZipLinesReader(DataSourceReader):
    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern = path, pattern

    def _opened(self, archive: str) -> zipfile.ZipFile:
        return zipfile.ZipFile(file_system(self.path)[0].open_input_file(archive))

    def partitions(self) -> list[Member]:
        files, at = file_system(self.path)
        found = files.get_file_info(at)
        archives = [at] if found.type == fs.FileType.File else [f.path for f in files.get_file_info(fs.FileSelector(at, recursive=True)) if f.path.lower().endswith(".zip")]
        out: list[Member] = []
        for archive in sorted(archives):
            try:
                with self._opened(archive) as z:
                    out += [Member(archive, i.filename) for i in z.infolist() if not i.is_dir() and fnmatch.fnmatchcase(i.filename, self.pattern)]
            except (OSError, ValueError, zipfile.BadZipFile) as e:
                out.append(Member(archive, None, f"{type(e).__name__}: {e}"))
        return out

    def read(self, partition: Member) -> Iterator[tuple[str, str | None, int, str | None, str | None]]:
        if partition.error:
            yield partition.archive, None, 0, None, partition.error
            return
        n = 0
        try:
            with self._opened(partition.archive) as z, z.open(partition.member) as raw:
                for n, line in enumerate(io.TextIOWrapper(raw, "utf-8", errors="replace", newline="\n"), 1):
                    yield partition.archive, partition.member, n, line.rstrip("\r\n"), None
        except Exception as e:  # noqa: BLE001  bad sums, unknown methods, broken streams: the member is at fault, not the job
            yield partition.archive, partition.member, n + 1, None, f"{type(e).__name__}: {e}"


class ZipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ZipLinesReader:
        return ZipLinesReader(self.options["path"], self.options.get("members", "*"))


def zip_lines(spark: SparkSession, path: str, members: str = "*") -> DataFrame:
    spark.dataSource.register(ZipLines)
    return spark.read.format("zip_lines").option("path", path).option("members", members).load()


def zipped_corpus(spark: SparkSession, path: str, members: str = "*corpus.jsonl", id_: str = "_id") -> DataFrame:
    """doc_id, content, error of the passages in archives: title and text as ``benchmarks.corpus`` has them; what can't be read has an error alone."""
    row = F.from_json("value", f"`{id_}` string, title string, text string")
    rows = zip_lines(spark, path, members).where("error IS NOT NULL OR trim(value) <> ''").withColumn("row", row)
    bad = F.when(F.col("error").isNull() & F.col(f"row.{id_}").isNull(), F.concat(F.lit("no passage in line "), F.col("line").cast("string")))
    text = F.when(F.col(f"row.{id_}").isNotNull(), passage_text(F.col("row.title"), F.col("row.text")))
    return rows.select(F.col(f"row.{id_}").alias("doc_id"), text.alias("content"), F.coalesce("error", bad).alias("error"))
