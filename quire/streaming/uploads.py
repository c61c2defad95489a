"""Uploads as a stream: new text files in a folder become lines, and each batch is indexed as a table is.

With a ledger, a file that was sent before is passed over, and so is what a batch had written before it was run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.plans.indexing import Indexed, index_lines, index_pages, lines_of_text
from quire.sources.transcripts import pdf_pages, safe_upload_name
from quire.storage import Scratch

QUICK_PAGES = 10


class Ledger:
    """A table of what batches have written: (stream, batch, hash), the hash being that of a file's content.

    A batch's files are entered after its ``write``. So a batch that failed before that is written as a whole again, under the same
    number, and one that failed after it finds its files entered and writes nothing; a writer that replaces what it has under a number
    has each file once in either case.
    """

    def __init__(self, spark: SparkSession, folder: str, stream: str = "uploads"):
        self.spark, self.folder, self.stream = spark, folder, stream

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema("stream string, batch long, hash string").parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "stream string, batch long, hash string")

    def fresh(self, batch: DataFrame, content: str, order: str = "path") -> DataFrame:
        """``batch`` without files whose content is entered, and one of those that are alike: the first by ``order``."""
        hashed = batch.withColumn("hash", F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary")), 256))
        first = hashed.groupBy("hash").agg(F.min(order).alias(order))
        known = self.entries().where(F.col("stream") == self.stream).select("hash")
        return hashed.join(first.join(known, "hash", "left_anti"), ["hash", order], "left_semi")

    def enter(self, fresh: DataFrame, number: int) -> None:
        rows = fresh.select(F.lit(self.stream).alias("stream"), F.lit(number).cast("long").alias("batch"), "hash")
        rows.write.mode("append").parquet(self.folder)


def _each(spark: SparkSession, ledger: str | None, content: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """What is done with a batch: ``write`` it, or what of it is new to the ledger."""
    if ledger is None:
        return write
    book = Ledger(spark, ledger)

    def each(batch: DataFrame, number: int) -> None:
        scratch = Scratch(spark, "uploads")
        fresh = scratch.keep(book.fresh(batch, content), "fresh")
        if not fresh.isEmpty():
            write(fresh.drop("hash"), number)
            book.enter(fresh, number)
        scratch.clear()

    return each


def read_uploads(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(doc_id, path, text) of text files as they arrive; doc_id is the path's hash."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.input_file_name().alias("path"), F.col("value").alias("text"))


def index_uploads(uploads: DataFrame, checkpoint: str, write: Callable[[Indexed, int], None], ledger: str | None = None, **options) -> StreamingQuery:
    """Indexes all files that are there, batch by batch, and ends; ``write`` gets a batch's tables and number, and
    may see a batch again after a failure. With ``ledger``, a folder, files that were written before are passed over (see ``Ledger``).
    A batch's tables are removed when it is written."""

    def indexed(batch: DataFrame, number: int) -> None:
        tables = index_lines(lines_of_text(batch), **options)
        write(tables, number)
        tables.close()

    each = _each(uploads.sparkSession, ledger, "text", indexed)
    return uploads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_binary_uploads(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Files of any kind as they arrive: path, modificationTime, length and content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.schema(schema).format("binaryFile").option("maxFilesPerTrigger", files_per_batch).load(folder)


def page_limit(mode: str = "quick", max_pages: int | None = None) -> int | None:
    """How many pages an upload is read for: all if ``full``, else the given number, and ten if ``quick`` has none."""
    if mode == "full":
        return None
    if max_pages and max_pages > 0:
        return max_pages
    return QUICK_PAGES if mode == "quick" else None


def index_binary_uploads(uploads: DataFrame, extract: Callable, checkpoint: str, write: Callable[[Indexed, DataFrame, int], None], mode: str = "quick", max_pages: int | None = None, ledger: str | None = None, **options) -> StreamingQuery:
    """Indexes uploaded files, read by ``extract`` (see ``pdf_pages``), batch by batch; ``write`` gets a batch's tables, its names
    (doc_id, path, filename) and its number, and may see a batch again after a failure. A file's id is its path's hash. ``ledger`` is as in
    ``index_uploads``."""

    def indexed(batch: DataFrame, number: int) -> None:
        names = batch.select(F.xxhash64("path").alias("doc_id"), "path", safe_upload_name(F.regexp_extract("path", "[^/]*$", 0)).alias("filename"))
        pages = pdf_pages(batch, extract).withColumn("doc_id", F.xxhash64("path")).drop("path")
        tables = index_pages(pages, max_pages=page_limit(mode, max_pages), **options)
        write(tables, names, number)
        tables.close()

    each = _each(uploads.sparkSession, ledger, "content", indexed)
    return uploads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
