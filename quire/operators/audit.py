"""Audit of what the topics leave uncovered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

#: Words that make a gap administrative, and what a gap without text shows.
ADMINISTRATIVE = ("RECESS", "OFF THE RECORD", "EXAMINATION CONTINUED", "WHEREUPON")
NO_TEXT = "(Blank lines / formatting)"
CRITICAL_LINES, SAMPLE = 5, 120
SPACES = max(word.count(" ") for word in ADMINISTRATIVE)


def mark_covered(lines: DataFrame, topics: DataFrame) -> DataFrame:
    """``lines`` with ``covered``: whether a topic's closed range holds the coordinate.

    Lines and the starts of topics are sorted together by coordinate: the furthest end of the topics that have begun is the end of
    their union, and a line is covered if it isn't beyond it. So each line is read once and meets no list of topics, and no
    range is spread over its pages. Topics without a whole range cover nothing, as do those of no document; lines
    without a coordinate are not covered. A given column ``covered`` is replaced.
    """
    names = [c for c in lines.columns if c != "covered"]
    given = lines.select("doc_id", "page", "line", F.lit(1).alias("kind"), F.struct(*names).alias("row"))
    placed = F.col("start_page").isNotNull() & F.col("start_line").isNotNull() & F.col("end_page").isNotNull() & F.col("end_line").isNotNull()
    begun = topics.where(F.col("doc_id").isNotNull() & placed).select("doc_id", F.col("start_page").alias("page"), F.col("start_line").alias("line"), F.lit(0).alias("kind"), F.struct(F.col("end_page").alias("page"), F.col("end_line").alias("line")).alias("end"))
    both = given.unionByName(begun, allowMissingColumns=True)
    so_far = W.partitionBy("doc_id").orderBy("page", "line", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("end", F.max("end").over(so_far)).where("kind = 1")
    inside = F.col("page").isNotNull() & F.col("line").isNotNull() & (F.struct("page", "line") <= F.col("end"))
    return both.select(*(F.col("row").getField(c).alias(c) for c in names), F.coalesce(inside, F.lit(False)).alias("covered"))


def _islands(marked: DataFrame) -> DataFrame:
    """A row of each island of uncovered lines in canonical order, and one of a document's covered lines (``island`` null).

    Everything is by document, so that one shuffle serves the marks, the islands and what is counted of them.
    """
    by = W.partitionBy("doc_id").orderBy("global_line_id")
    rows = marked.withColumn("island", F.sum(F.col("covered").cast("long")).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # lines of one coordinate are covered once
    again = F.row_number().over(W.partitionBy("doc_id", "covered", "page", "line").orderBy("global_line_id")) > 1
    rows = rows.withColumns({"again": again, "island": F.when(~F.col("covered"), F.col("island"))})
    g = F.col("global_line_id")
    rows = rows.withColumn("said", F.coalesce(T.not_blank(F.col("text")), F.lit(False)) & ~F.col("covered"))
    rank = F.sum(F.col("said").cast("long")).over(W.partitionBy("doc_id", "island").orderBy("global_line_id"))
    # a sample needs no more lines than it has characters; a phrase with so many spaces goes over so many ends of lines
    near = F.collect_list("text").over(W.partitionBy("doc_id", "island", "said").orderBy("global_line_id").rowsBetween(-SPACES, 0))
    named = F.lit(False)
    for word in ADMINISTRATIVE:
        named = named | F.col("near").contains(word)
    rows = rows.withColumns({"rank": rank, "near": F.when(F.col("said"), F.upper(F.array_join(near, " ")))}).withColumn("named", F.coalesce(named, F.lit(False)))
    said = F.array_sort(F.collect_list(F.when(F.col("said") & (F.col("rank") <= SAMPLE), F.struct("global_line_id", F.substring("text", 1, SAMPLE).alias("text")))))
    rows = rows.groupBy("doc_id", "island").agg(
        F.min_by("page", g).alias("start_page"), F.min_by("line", g).alias("start_line"),
        F.max_by("page", g).alias("end_page"), F.max_by("line", g).alias("end_line"),
        F.count("*").alias("line_count"), F.count_if(~F.col("again")).alias("places"), F.min(g).alias("at"),
        said.alias("said"), F.bool_or("named").alias("named"), F.bool_or("said").alias("any"),
    )
    text = F.array_join(F.transform("said", lambda r: r["text"]), " ")
    benign = ~F.col("any") | F.col("named")
    sample = F.when(text == "", F.lit(NO_TEXT)).otherwise(F.substring(text, 1, SAMPLE))
    return rows.withColumns({"sample_text": sample, "is_administrative": benign}).drop("said", "named", "any")


SEGMENT = ("start_page", "start_line", "end_page", "end_line", "line_count", "sample_text", "is_administrative")


def gaps(marked: DataFrame) -> DataFrame:
    """Islands of uncovered lines in canonical order, one row each, numbered from 1 in ``gap``."""
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("at"))
    return _islands(marked).where("island is not null").select("doc_id", number.alias("gap"), *SEGMENT)


def coverage(marked: DataFrame) -> DataFrame:
    """(doc_id, total_lines, covered_lines, coverage_percentage); lines of one coordinate are covered once.

    The share is rounded half up, so a tie in the third place may differ from rounding half to even.
    """
    at = F.when(F.col("covered"), F.struct("page", "line"))
    rows = marked.groupBy("doc_id").agg(F.count("*").alias("total_lines"), F.count_distinct(at).alias("covered_lines"))
    share = F.round(100.0 * F.col("covered_lines") / F.greatest(F.lit(1), F.col("total_lines")), 2)
    return rows.withColumn("coverage_percentage", share)


def omission_report(lines: DataFrame, topics: DataFrame) -> DataFrame:
    """One row of each document: coverage, its gaps, how many of them are administrative, and if one is critical."""
    gap = F.col("island").isNotNull()
    found = _islands(mark_covered(lines, topics)).groupBy("doc_id").agg(
        F.sum("line_count").alias("total_lines"), F.coalesce(F.sum(F.when(~gap, F.col("places"))), F.lit(0)).cast("long").alias("covered_lines"),
        F.count_if(gap).alias("n_gaps"), F.count_if(gap & F.col("is_administrative")).alias("n_administrative"),
        F.bool_or(gap & ~F.col("is_administrative") & (F.col("line_count") > CRITICAL_LINES)).alias("has_critical_omissions"),
        F.array_sort(F.collect_list(F.when(gap, F.struct("at", *SEGMENT)))).alias("found"),
    )
    segments = F.transform("found", lambda s, k: F.struct((k + 1).alias("gap"), *(s[c].alias(c) for c in SEGMENT)))
    share = F.round(100.0 * F.col("covered_lines") / F.greatest(F.lit(1), F.col("total_lines")), 2)
    return found.select(
        "doc_id", "total_lines", "covered_lines", share.alias("coverage_percentage"), "n_gaps", "n_administrative", "has_critical_omissions",
        F.when(F.col("n_gaps") > 0, segments).alias("uncovered_segments"),
    )
