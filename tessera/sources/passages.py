"""A file for each passage: a sink that leaves nothing half written.

``df.write.format("passage_files").option("path", folder)`` takes rows (name, content), and writes each to
``<first two letters>/<name>.txt`` below the folder. What is there already is left as it is. A file is written in a
folder of its task's attempt and moved to its place when it is whole, so that a task or job that dies leaves whole
files, which the next run passes over, and parts of files in its own folder alone, which an abort removes. The same
name twice is one file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.streaming.changes import file_system

ATTEMPTS = ".attempts"


@dataclass
class Written(WriterCommitMessage):
    written: int
    reused: int


class PassageFilesWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        files, at = file_system(self.path)
        own, made, done = f"{at}/{ATTEMPTS}/{self.job}/{uuid.uuid4().hex}", set(), Written(0, 0)
        for row in iterator:
            folder = f"{at}/{row['name'][:2]}"
            if files.get_file_info(f"{folder}/{row['name']}.txt").type == fs.FileType.File:
                done.reused += 1
                continue
            for needed in {own, folder} - made:
                files.create_dir(needed)
                made.add(needed)
            with files.open_output_stream(f"{own}/whole") as f:
                f.write((row["content"] or "").encode())
            files.move(f"{own}/whole", f"{folder}/{row['name']}.txt")
            done.written += 1
        return done

    def commit(self, messages: list[Written | None]) -> None:
        self._cleared()

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared()

    def _cleared(self) -> None:
        files, at = file_system(self.path)
        if files.get_file_info(f"{at}/{ATTEMPTS}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{at}/{ATTEMPTS}/{self.job}")


class PassageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "passage_files"

    def writer(self, schema: StructType, overwrite: bool) -> PassageFilesWriter:
        return PassageFilesWriter(self.options["path"])


def write_passages(passages: DataFrame, path: str) -> None:
    """Write passages (name, content); see the module. Rows of one name meet in one task, which writes it once."""
    passages.sparkSession.dataSource.register(PassageFiles)
    once = passages.select("name", "content").dropDuplicates(["name"])
    once.write.format("passage_files").option("path", path).mode("append").save()
