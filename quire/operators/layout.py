"""Canonical lines laid out by page: what the look-ups, quotations and ranges of topics read, once a page and not once a line.

A row is a run: lines that follow each other in a document and are on one page, ``LONGEST`` at most, so that a row is bounded. It
has a cell for each line (place, whether it is blank) and its text, the normalised texts of those that a quotation may lie in, and
of the nine such lines after it. Written by ``shared``, the rows are in buckets of (doc_id, page) and sorted, so that joins
by page move the topics only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.storage import Scratch

WINDOW_LINES, LONGEST = 10, 256


@dataclass
class Layout:
    """Runs of lines (doc_id, page, run, cells, texts, said, tail), each document's least and largest page, and where what is found may be kept."""

    runs: DataFrame
    limits: DataFrame
    scratch: Scratch | None = None


def page_limits(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.min("page").alias("min_page"), F.max("page").alias("max_page"))


def page_runs(lines: DataFrame) -> DataFrame:
    """The runs of ``lines`` (doc_id, page, line, global_line_id, text), of one shuffle by document."""
    by = W.partitionBy("doc_id").orderBy("global_line_id")
    begins = F.when(F.lag("page").over(by) == F.col("page"), 0).otherwise(1)
    rows = lines.select("doc_id", "page", "line", "global_line_id", "text").withColumn("begins", begins).withColumn("block", F.sum("begins").over(by))
    place = F.row_number().over(W.partitionBy("doc_id", "block").orderBy("global_line_id")) - 1
    rows = rows.withColumn("part", F.floor(place / LONGEST))
    blank = ~T.not_blank(F.col("text"))
    cell = F.struct("global_line_id", "line", F.coalesce(blank, F.lit(True)).alias("blank"), "text")
    # quotations are looked for in lines 1 to 25 only
    said = F.when(~blank & F.col("line").between(1, 25), F.struct("global_line_id", "page", "line", T.plain(F.col("text")).alias("plain")))
    runs = rows.groupBy("doc_id", "block", "part").agg(F.any_value("page").alias("page"), F.array_sort(F.collect_list(cell)).alias("cells"), F.array_sort(F.collect_list(said)).alias("said"))
    # runs in which something is said are numbered: the nine after any other hold its nine lines at least
    speaks = F.size("said") > 0
    order = W.partitionBy("doc_id").orderBy("block", "part")
    runs = runs.withColumn("nth", F.sum(F.when(speaks, 1).otherwise(0)).over(order))
    after = W.partitionBy("doc_id").orderBy("nth").rangeBetween(1, WINDOW_LINES - 1)
    later = F.flatten(F.collect_list(F.when(speaks, F.slice("said", 1, WINDOW_LINES - 1))).over(after))
    tail = F.when(speaks, F.slice(later, 1, WINDOW_LINES - 1)).otherwise(F.slice("said", 1, 0))
    # texts are a column of their own, as most reads need places only
    texts, cells = F.transform("cells", lambda c: c["text"]), F.transform("cells", lambda c: c.dropFields("text"))
    return runs.withColumn("tail", tail).select("doc_id", "page", F.struct("block", "part").alias("run"), cells.alias("cells"), texts.alias("texts"), "said", "tail")


def of_lines(lines: DataFrame) -> Layout:
    """The layout as a plan, for what reads it once."""
    runs = page_runs(lines)
    return Layout(runs, page_limits(lines))


def shared(scratch: Scratch, lines: DataFrame) -> Layout:
    """The layout as a bucketed table, for what reads it several times."""
    runs = scratch.keep_bucketed(page_runs(lines), ["doc_id", "page"], "runs")
    return Layout(runs, scratch.keep_bucketed(page_limits(runs), ["doc_id"], "limits"), scratch)


def pages_of(first: Column, last: Column) -> Column:
    """The pages of a closed range; none if an end is missing or before the start."""
    return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))
