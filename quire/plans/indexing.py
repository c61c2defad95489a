"""The whole plan: pages or plain texts to lines, chunks, candidates, verdicts, merged topics and audit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import audit, chunks, layout, lines, merge, validate
from quire.sources import transcripts
from quire.storage import Scratch


@dataclass
class Indexed:
    """The tables of a run. Lines, candidates, verdicts and topics are written already, the others are lazy."""

    lines: DataFrame
    chunked: DataFrame
    cleaned: DataFrame
    candidates: DataFrame
    validated: DataFrame
    topics: DataFrame
    report: DataFrame
    failures: DataFrame
    scratch: Scratch

    def close(self) -> None:
        """Removes what was written for the run; its tables can't be read after that."""
        self.scratch.clear()


def lines_of_pages(pages: DataFrame, start_page: int | None = None, end_page: int | None = None, max_pages: int | None = None, metadata: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Canonical lines of page texts and blocks; the range of pages is looked for in each document unless given. ``scratch`` is as in
    ``operators.lines.parse_cells``."""
    about = metadata if metadata is not None else lines.document_metadata(pages)
    names = about.select("doc_id", F.nullif(T.short_witness(F.col("witness")), F.lit("")).alias("witness"), F.nullif(T.short_attorney(F.col("attorney")), F.lit("")).alias("attorney"))
    bounds = lines.testimony_bounds(pages)
    bounds = bounds.select("doc_id", (F.lit(start_page) if start_page is not None else F.col("start_page")).alias("lo"), (F.lit(end_page) if end_page is not None else F.col("end_page")).alias("hi"))
    if max_pages is not None:
        bounds = bounds.withColumn("hi", F.least("hi", F.col("lo") + max_pages - 1))
    seen = transcripts.scan_pages(pages.join(bounds, "doc_id"), F.col("lo"), F.col("hi"))
    cells = transcripts.dense_block_lines(seen).join(names, "doc_id")
    return lines.parse_cells(cells, F.col("attorney"), F.col("witness"), scratch)


def lines_of_text(docs: DataFrame) -> DataFrame:
    """Canonical lines of plain texts: no speakers but the one who examines, no timestamps."""
    grid = transcripts.grid_of_text(docs)
    speaker = lines.continued_speaker(F.lit(None).cast("string"), F.col("text"))
    return grid.select("doc_id", "global_line_id", "page", "line", speaker.alias("speaker"), "text", F.lit(None).cast("string").alias("timestamp"), F.col("text").alias("raw_text"))


def index_lines(canonical: DataFrame, extractor: Callable[[str], str] | None = None, metadata: DataFrame | None = None, pages_per_chunk: int = 12, overlap: int = 2, fuzzy: bool = True, similarity: float = 0.70, stand_in: bool = True, pause: float = 0.0, answers_table: str | None = None, scratch: Scratch | None = None) -> Indexed:
    """All stages after parsing. Extraction sees the cleaned chunks, checks the lines as they are.

    With ``answers_table``, a folder that outlives the run, only prompts that no earlier run got an answer to are asked.

    Without an extractor each block of lines is a candidate. With one, ``failures`` has the chunks for which it gave no answer, and
    ``pause`` is how many seconds it rests between calls; a document all of whose chunks failed is one topic over
    all its lines, if ``stand_in``. Lines, candidates, verdicts and topics are written once to shared storage, as later
    stages read them several times; Spark jobs run when this is called.
    """
    scratch = scratch or Scratch(canonical.sparkSession, "index")
    canonical = scratch.keep(canonical, "lines")
    chunked = chunks.chunk_lines(canonical, pages_per_chunk, overlap)
    cleaned = chunks.clean_chunks(chunked)
    none = canonical.sparkSession.createDataFrame([], "doc_id long, chunk_id int, error string")
    if extractor:
        asked = chunks.prompts(cleaned, metadata)
        answers = chunks.resumed_answers(scratch, asked, extractor, answers_table, pause=pause) if answers_table else chunks.extractor_answers(asked, extractor, pause=pause)
        answers = scratch.keep(answers, "answers")
        failures = answers.where("error is not null").select("doc_id", "chunk_id", "error")
        candidates = chunks.decode_candidates(answers)
    else:
        failures, candidates = none, chunks.block_candidates(canonical)
    candidates = scratch.keep(candidates, "candidates")
    validated = scratch.keep(validate.validate(candidates, layout.shared(scratch, canonical), fuzzy), "verdicts")
    topics = merge.merge_topics(validated, similarity)
    if extractor and stand_in:
        lost = answers.groupBy("doc_id").agg(F.bool_and(F.col("error").isNotNull()).alias("lost")).where("lost").select("doc_id")
        topics = topics.unionByName(structural_topic(canonical.join(lost, "doc_id", "left_semi")))
    topics = scratch.keep(topics, "topics")
    return Indexed(canonical, chunked, cleaned, candidates, validated, topics, audit.omission_report(canonical, topics), failures, scratch)


def index_pages(pages: DataFrame, extractor: Callable[[str], str] | None = None, max_pages: int | None = None, **options) -> Indexed:
    """Parse, index and audit in one call: page texts and blocks (see ``sources.transcripts``) to topics and report. Pages are
    written once, as metadata, bounds and lines each read them."""
    scratch = Scratch(pages.sparkSession, "index")
    pages = scratch.keep(pages, "pages")
    about = scratch.keep(lines.document_metadata(pages), "about")
    return index_lines(lines_of_pages(pages, max_pages=max_pages, metadata=about), extractor, about, scratch=scratch, **options)


def structural_topic(canonical: DataFrame, name: str = "Full Testimony") -> DataFrame:
    """One verified topic from each document's first line with text to its last one (or over blank lines, if it has no others), quoting
    the first: what stands in when a run has failed."""
    said = F.when(T.not_blank(F.col("text")), F.col("global_line_id"))
    some = canonical.withColumn("g", F.coalesce(said, F.when(F.max(said).over(W.partitionBy("doc_id")).isNull(), F.col("global_line_id"))))
    g = F.col("g")
    ends = some.groupBy("doc_id").agg(*(f(c, g).alias(f"{w}_{c}") for w, f in (("start", F.min_by), ("end", F.max_by)) for c in ("page", "line")), F.min(g).alias("start_global_id"), F.max(g).alias("end_global_id"), F.min_by("text", g).alias("supporting_quote"))
    return ends.select("doc_id", F.lit(0).cast("long").alias("candidate_id"), F.lit(name).alias("topic"), "start_page", "start_line", "end_page", "end_line", "start_global_id", "end_global_id", F.lit("").alias("summary"), "supporting_quote", F.lit(1.0).alias("confidence"), F.lit(True).alias("verified"), F.lit(False).alias("needs_human_review"))
