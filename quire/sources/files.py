"""A sink of whole files: ``df.write.format("quire_files")`` writes each row (path, content) to a file of its own on the executors.

A file is written under a name in a staging folder and moved to its own when it is whole, so a task that is killed leaves no half
file, and one that runs again writes the same files again. The driver gets a count from each task and no names. The
folder may be of any file system that pyarrow knows, and has to be one that all executors share.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, DONE = "quire_files", "_SUCCESS"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


@dataclass
class Written(WriterCommitMessage):
    files: int


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.staging = folder.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = opened(self.folder)
        staged, made, n = posixpath.join(root, self.staging, uuid.uuid4().hex), set(), 0
        system.create_dir(staged, recursive=True)
        for row in iterator:
            path = posixpath.normpath(row["path"])
            if path.startswith(("/", "..")):
                raise ValueError(f"{row['path']!r} is outside the folder")
            whole, final = posixpath.join(staged, str(n)), posixpath.join(root, path)
            with system.open_output_stream(whole) as out:
                out.write((row["content"] or "").encode())
            home = posixpath.dirname(final)
            if home not in made:
                system.create_dir(home, recursive=True)
                made.add(home)
            system.move(whole, final)
            n += 1
        return Written(n)

    def _clear(self) -> tuple[fs.FileSystem, str]:
        system, root = opened(self.folder)
        staging = posixpath.join(root, self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)
        return system, root

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = self._clear()
        system.create_dir(root, recursive=True)
        with system.open_output_stream(posixpath.join(root, DONE)) as out:
            out.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What was moved already stays: these are whole files."""
        self._clear()


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("rows need a path and a content")
        return FilesWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    """Writes ``files`` (path, content) below a folder; paths that repeat are written over each other. A null content is an empty file."""
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(Files)
    files.select("path", "content").write.format(FORMAT).mode("append").save(folder)
