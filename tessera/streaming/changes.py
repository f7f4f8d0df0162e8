"""Changed files as a stream: a source whose offsets are listings.

``spark.readStream.format("changed_files")`` with the options ``root`` and ``state`` gives a row for each file that came,
changed or went: path, op (add, change, unlink), mtime (milliseconds since 1970), size. Each look lists the root and,
if something differs, writes the listing below ``state`` as so many Parquet files, dealt by the hash of the path; an
offset names a listing. A batch is the difference of two listings, file by file: so many tasks, none of which sees
the whole. A stream that is restarted goes on from the listing in its checkpoint, without loss or repeat.

A file that was written within the ``settle`` seconds before a look is as it was in the listing before, so that it
comes once it is left alone. Files and folders that begin with a dot are passed over, as are ``ignore`` patterns
(comma-joined, as for the scan) and names without an indexable ending. ``state`` has to be a folder that driver and
executors share, and one stream's alone. Local paths and stores that Arrow's file systems know can be listed.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tessera.operators.catalog import INDEXED_ENDINGS

SCHEMA = "path string, op string, mtime long, size long"
LISTING = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("size", pa.int64())])


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    found, at = fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)
    return found, at.rstrip("/")


def passed_over(relative: str, patterns: list[str]) -> bool:
    """Whether a path below the root is none of the stream's: hidden, ignored, or not indexable."""
    if any(part.startswith(".") for part in relative.split("/")) or not re.search(INDEXED_ENDINGS, relative):
        return True
    for p in patterns:
        if relative.endswith(p[1:]) if p.startswith("*.") else relative == p or relative.startswith(f"{p}/") or f"/{p}/" in relative:
            return True
    return False


class Part(InputPartition):
    def __init__(self, start: int, end: int, index: int) -> None:
        super().__init__((start, end, index))
        self.start, self.end, self.index = start, end, index


class ChangedFilesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.state = options["root"], options["state"]
        self.settle = float(options.get("settle", "0.2"))
        self.parts = int(options.get("parts", "16"))
        self.ignore = [p for p in options.get("ignore", "").split(",") if p]

    def _at(self, number: int, index: int) -> tuple[fs.FileSystem, str]:
        files, at = file_system(self.state)
        return files, f"{at}/{number:012d}/{index:04d}.parquet"

    def _listing(self, number: int, index: int) -> dict[str, tuple[int, int]]:
        if not number:
            return {}
        files, at = self._at(number, index)
        with files.open_input_file(at) as f:
            rows = pq.read_table(f, schema=LISTING)
        return dict(zip(rows["path"].to_pylist(), zip(rows["mtime"].to_pylist(), rows["size"].to_pylist(), strict=True), strict=True))

    def _numbers(self) -> list[int]:
        """The listings that are whole: their marks are written last."""
        files, at = file_system(self.state)
        found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(".whole"))

    def _looked(self) -> list[dict[str, tuple[int, int]]]:
        """What is below the root now, by part, with files that aren't settled as ``None``."""
        files, at = file_system(self.root)
        parts: list[dict] = [{} for _ in range(self.parts)]
        settled = int((time.time() - self.settle) * 1000)
        for f in files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)):
            relative = f.path[len(at) :].lstrip("/")
            if f.type == fs.FileType.File and not passed_over(relative, self.ignore):
                mtime = f.mtime_ns // 1_000_000
                parts[zlib.crc32(f.path.encode()) % self.parts][f.path] = (mtime, f.size) if mtime <= settled else None
        return parts

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last = max(self._numbers(), default=0)
        now, changed = self._looked(), False
        for index, part in enumerate(now):
            before = self._listing(last, index)
            for path in [p for p, seen in part.items() if seen is None]:
                part.pop(path)
                if path in before:
                    part[path] = before[path]
            changed = changed or part != before
        if not changed:
            return {"listing": last}
        files, at = file_system(self.state)
        files.create_dir(f"{at}/{last + 1:012d}")
        for index, part in enumerate(now):
            paths = sorted(part)
            rows = pa.table([paths, [part[p][0] for p in paths], [part[p][1] for p in paths]], schema=LISTING)
            with files.open_output_stream(self._at(last + 1, index)[1]) as f:
                pq.write_table(rows, f)
        with files.open_output_stream(f"{at}/{last + 1:012d}.whole") as f:
            f.write(b"")
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(start["listing"], end["listing"], i) for i in range(self.parts)]

    def read(self, partition: Part) -> Iterator[tuple[str, str, int, int]]:
        before, after = (self._listing(n, partition.index) for n in (partition.start, partition.end))
        for path, seen in after.items():
            if before.get(path) != seen:
                yield (path, "change" if path in before else "add", *seen)
        for path in before.keys() - after.keys():
            yield (path, "unlink", *before[path])

    def commit(self, end: dict) -> None:
        """Listings before the one that the next batch begins with are needed no more."""
        files, at = file_system(self.state)
        for number in self._numbers():
            if number < end["listing"]:
                files.delete_file(f"{at}/{number:012d}.whole")
                files.delete_dir(f"{at}/{number:012d}")


class ChangedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> ChangedFilesReader:
        return ChangedFilesReader(dict(self.options))


def changed_files(spark: SparkSession, root: str, state: str, **options: object):
    """The stream of a root's changes; see the module."""
    spark.dataSource.register(ChangedFiles)
    reader = spark.readStream.format("changed_files").option("root", root).option("state", state)
    return reader.options(**{k: str(v) for k, v in options.items()}).load()
