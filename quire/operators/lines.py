"""From raw cells to the canonical lines: timestamps, speakers and their continuity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.schemas import LINES_PER_PAGE
from quire.storage import Scratch

#: What a document is searched for.
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_WITNESS = r"(?i)DEPOSITION\s+OF\s+([A-Z\s\.\,\-]+?)(?:\n|\r|\t|Taken|held|Tuesday|Wednesday|Monday|Thursday|Friday|Saturday|Sunday|March|April|May|June|July|August|September|October|November|December)"
_WITNESS_2 = r"(?i)WITNESS\s*[:\-]?\s*([A-Z\s\.\,\-]+?)(?:\n|\r|\t|By\s|Page)"
_ATTORNEY = r"(?i)BY\s+(MR\.\s+[A-Z]+|MS\.\s+[A-Z]+)"
_DATE = rf"(?i)((?:{_MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?,\s+\d{{4}})"
_CASE = r"(?i)(?:matter\s+of|case\s+of)\s+([A-Z\s\.\,\-]+?\s+(?:vs\.?|v\.?)\s+[A-Z\s\.\,\-]+?)(?:,|\n|\r|\.|\;)"
_CASE_2 = r"(?i)([A-Z\s\.\,\-]+?\s+(?:vs\.?|v\.?)\s+[A-Z\s\.\,\-]+?)(?:,|\n|\r|\.|\;)"


def continued_speaker(new_speaker: Column, text: Column, by: str = "doc_id", order: str = "global_line_id") -> Column:
    """The last named speaker so far; before any, EXAMINATION from the first text on."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.coalesce(F.last(new_speaker, ignorenulls=True).over(w), F.when(F.max(text != "").over(w), F.lit("EXAMINATION")), F.lit(""))


def scanned_in_ranges(scratch: Scratch, rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (doc_id, new_speaker, text and the columns of ``order``) with ``global_line_id`` and ``speaker``, as windows over whole
    documents give them, but for documents of any size: no task has more than a range of one.

    Rows are written in ranges of (doc_id, order). In each range a document's lines are numbered and speakers carried on by
    themselves; a row for each range and document then says how many lines, which last speaker and whether a text came
    before it, and that is joined back.
    """
    n = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.keep(rows.repartitionByRange(n, "doc_id", *order).withColumn("range", F.spark_partition_id()), "ranges")
    by = W.partitionBy("range", "doc_id").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = ranged.withColumns({"nth": F.count(F.lit(1)).over(by), "named": F.last("new_speaker", ignorenulls=True).over(by), "said": F.coalesce(F.max(F.col("text") != "").over(by), F.lit(False))})
    place = F.struct(*order)
    ends = ranged.groupBy("range", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("new_speaker", F.when(F.col("new_speaker").isNotNull(), place)).alias("last"), F.coalesce(F.bool_or(F.col("text") != ""), F.lit(False)).alias("any"),
    )
    before = W.partitionBy("doc_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(
        F.col("range").alias("r"), F.col("doc_id").alias("d"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"),
        F.last("last", ignorenulls=True).over(before).alias("named_before"), F.coalesce(F.max("any").over(before), F.lit(False)).alias("said_before"),
    )
    both = here.join(ends, (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")))
    speaker = F.coalesce("named", "named_before", F.when(F.col("said") | F.col("said_before"), F.lit("EXAMINATION")), F.lit(""))
    return both.select(*rows.columns, (F.col("nth") + F.col("lines_before")).cast("long").alias("global_line_id"), speaker.alias("speaker"))


def parse_cells(cells: DataFrame, attorney: Column | str | None = None, witness: Column | str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Canonical lines of cells (doc_id, page_idx, page, line, content), numbered in file order.

    ``attorney`` and ``witness`` are short names in capitals, or columns of ``cells``; where they are null, questions and answers name nobody.
    With ``scratch``, documents that are too large for a task are scanned in ranges (see ``scanned_in_ranges``).
    """
    attorney, witness = (c if isinstance(c, Column) else F.lit(c).cast("string") for c in (attorney, witness))
    # one step each, so that no pattern is tried twice on a line
    rows = cells.select("doc_id", "page_idx", "page", "line", "content", attorney.alias("attorney"), witness.alias("witness"), T.timestamp_of(F.col("content")).alias("timestamp"))
    rows = rows.withColumn("plain", T.without_timestamp(F.col("content"), F.col("timestamp")))
    rows = rows.withColumn("tag", T.tag_of(F.col("plain")))
    named = T.speaker_named(F.col("tag"), F.col("attorney"), F.col("witness"))
    rows = rows.select("doc_id", "page_idx", "page", "line", named.alias("new_speaker"), T.spoken(F.col("plain"), F.col("tag")).alias("text"), "timestamp", F.col("content").alias("raw_text"))
    if scratch:
        rows = scanned_in_ranges(scratch, rows, ["page_idx", "line"])
    else:
        number = F.row_number().over(W.partitionBy("doc_id").orderBy("page_idx", "line")).cast("long")
        rows = rows.withColumn("global_line_id", number).withColumn("speaker", continued_speaker(F.col("new_speaker"), F.col("text")))
    return rows.select("doc_id", "global_line_id", "page", "line", "speaker", "text", "timestamp", "raw_text")


def _found(text: Column, *patterns: str) -> Column:
    return F.coalesce(*(F.nullif(T.stripped(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns))


def document_metadata(pages: DataFrame, witness: str | None = None, attorney: str | None = None, date: str | None = None, case_name: str | None = None) -> DataFrame:
    """(doc_id, witness, attorney, date, case_name) from the first ten pages; what isn't found has the given value, or null."""
    first = pages.where("page_idx < 10").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: p["text"]), "\n")
    first = first.select("doc_id", text.alias("text"))
    t = F.col("text")
    name = F.coalesce(_found(t, _WITNESS, _WITNESS_2), F.lit(witness).cast("string"))
    words = F.transform(F.filter(F.split(name, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return first.select(
        "doc_id",
        F.array_join(words, " ").alias("witness"),
        F.coalesce(_found(t, _ATTORNEY), F.lit(attorney).cast("string")).alias("attorney"),
        F.coalesce(_found(t, _DATE), F.lit(date).cast("string")).alias("date"),
        # the patterns take quadratic time where no parties are named, so a linear one goes first
        F.coalesce(F.when(t.rlike(r"(?i)\sv(?:s?\.?)\s"), _found(t, _CASE, _CASE_2)), F.lit(case_name).cast("string")).alias("case_name"),
    )


def testimony_bounds(pages: DataFrame, default_start: int = 7, default_end: int = 88) -> DataFrame:
    """(doc_id, start_page, end_page) of testimony: from what the index cites, or the first question, to the last
    page before certificates, oaths and word indexes."""
    from quire.sources.transcripts import STOP_MARKERS, printed_page

    upper = F.upper("text")
    stop = upper.contains("I, ") & upper.contains("DO SOLEMNLY DECLARE UNDER PENALTY")
    for marker in STOP_MARKERS:
        stop = stop | upper.contains(marker)
    cited = F.regexp_extract("text", r"(?im)(?:EXAMINATION|DIRECT|TESTIMONY).*?(\d+)\s*$", 1)
    question = F.col("text").rlike(r"(?m)^\s*\d+\s+(?:BY\s+[A-Z\.\s]+:)?\s*Q[\.\:\s]")
    idx = F.col("page_idx")
    rows = pages.select(
        "doc_id",
        "page_idx",
        printed_page(F.col("text"), idx).alias("printed"),
        stop.alias("stop"),
        F.when((idx < 15) & upper.contains("INDEX"), cited.try_cast("int")).alias("cited"),
        question.alias("question"),
    )
    stops = F.min(F.when(F.col("stop"), idx)).over(W.partitionBy("doc_id"))
    rows = rows.withColumn("open", F.coalesce(idx < stops, F.lit(True)))
    found = rows.groupBy("doc_id").agg(
        F.min_by("cited", F.when(F.col("cited").isNotNull(), idx)).alias("cited"),
        F.min_by("printed", F.when(F.col("open") & F.col("question"), idx)).alias("asked"),
        F.min(F.when(F.col("open") & F.col("question"), idx)).alias("asked_idx"),
        F.max_by("printed", F.when(F.col("open"), idx)).alias("last"),
        F.max(F.when(F.col("open"), idx)).alias("last_idx"),
    )
    start = F.coalesce("cited", "asked")
    end = F.when(F.col("cited").isNotNull() | F.col("asked_idx").isNotNull(), F.col("last"))
    return found.select("doc_id", F.coalesce(start, F.lit(default_start)).alias("start_page"), F.coalesce(end, F.lit(default_end)).alias("end_page"))


def compact_text(lines: DataFrame) -> DataFrame:
    """(doc_id, compact) of the lines that aren't blank, tagged and in order."""
    row = T.compact_line(F.col("page"), F.col("line"), F.col("speaker"), F.col("text"))
    rows = lines.where(T.not_blank(F.col("text"))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("global_line_id", row.alias("s")))).alias("r"))
    return rows.select("doc_id", F.array_join(F.transform("r", lambda r: r["s"]), "\n").alias("compact"))


def page_groups(lines: DataFrame) -> DataFrame:
    """(doc_id, page, n_lines, first_line, last_line) of each page."""
    return lines.groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


def in_range(lines: DataFrame, sp: Column, sl: Column, ep: Column, el: Column) -> DataFrame:
    """Lines whose coordinate is in a closed range."""
    at = F.struct(F.col("page").alias("p"), F.col("line").alias("l"))
    return lines.where((at >= F.struct(sp.alias("p"), sl.alias("l"))) & (at <= F.struct(ep.alias("p"), el.alias("l"))))


assert LINES_PER_PAGE == 25  # coordinates and spans are those of a 25-line page
