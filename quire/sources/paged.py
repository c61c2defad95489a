"""A reader of paginated files that reads the wanted pages only.

``page_files(spark, folder, open_pages).where("page_idx between 3 and 8")`` gives (path, page_idx, text, blocks). ``open_pages`` turns a
file's bytes into a sequence of pages, ``len`` and ``[k] -> (text, [block, ...])``, as PDF libraries do: a page that a filter on ``page_idx``
rules out is never taken from it. Each file is a partition and is read where its task runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from quire.sources.files import opened

SCHEMA = "path string, page_idx int, text string, blocks array<string>"
BATCH, END = 64, 2**31 - 1

Pages = Sequence[tuple[str, Sequence[str]]]


@dataclass
class OneFile(InputPartition):
    path: str


class PagesReader(DataSourceReader):
    def __init__(self, folder: str, open_pages: Callable[[bytes], Pages]):
        self.folder, self.open_pages = folder, open_pages
        self.first, self.last, self.only = 0, END, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        """Takes comparisons of ``page_idx`` with numbers; Spark applies the others."""
        for f in filters:
            known = getattr(f, "attribute", None) == ("page_idx",)
            if known and isinstance(f, GreaterThan):
                self.first = max(self.first, f.value + 1)
            elif known and isinstance(f, GreaterThanOrEqual):
                self.first = max(self.first, f.value)
            elif known and isinstance(f, LessThan):
                self.last = min(self.last, f.value - 1)
            elif known and isinstance(f, LessThanOrEqual):
                self.last = min(self.last, f.value)
            elif known and isinstance(f, EqualTo):
                self.first, self.last = max(self.first, f.value), min(self.last, f.value)
            elif known and isinstance(f, In):
                self.only = set(f.value) if self.only is None else self.only & set(f.value)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        system, root = opened(self.folder)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.folder)
        if info.type == fs.FileType.File:
            return [OneFile(root)]
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [OneFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        with system.open_input_stream(partition.path) as f:
            pages = self.open_pages(f.read())
        wanted = [k for k in range(self.first, min(self.last + 1, len(pages))) if self.only is None or k in self.only]
        for at in range(0, len(wanted), BATCH):
            some = wanted[at : at + BATCH]
            read = [pages[k] for k in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * len(some)), pa.array(some, pa.int32()), pa.array([t for t, _ in read], pa.string()), pa.array([list(b) for _, b in read], pa.list_(pa.string()))],
                ["path", "page_idx", "text", "blocks"],
            )


def page_files(spark: SparkSession, folder: str, open_pages: Callable[[bytes], Pages]) -> DataFrame:
    """(path, page_idx, text, blocks) of the files below ``folder`` (or of one file); a missing one raises when pages are read.

    Filters on ``page_idx`` reach the reader if ``spark.sql.python.filterPushdown.enabled`` is set, which this does.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return "quire_pages"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> PagesReader:
            return PagesReader(self.options["path"], open_pages)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Paged)
    return spark.read.format("quire_pages").load(folder)
