"""Overlapping page windows, their cleaning, and what an extractor is given and gives back."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.schemas import TOPICS
from quire.storage import Scratch


def chunk_lines(lines: DataFrame, pages_per_chunk: int = 12, overlap: int = 2) -> DataFrame:
    """``lines`` with ``chunk_id``: windows of pages, each after the first beginning ``overlap`` pages before the last one's end.

    The windows that a page belongs to follow from its rank, so lines aren't compared with windows: each line is repeated as often
    as windows hold it.
    """
    step = max(1, pages_per_chunk - overlap)
    by = W.partitionBy("doc_id")
    rank = F.dense_rank().over(by.orderBy("page")) - 1
    rows = lines.withColumn("rank", rank).withColumn("pages", F.max("rank").over(by) + 1)
    last = F.when(F.col("pages") <= pages_per_chunk, F.lit(0)).otherwise(F.ceil((F.col("pages") - pages_per_chunk) / step)).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col("rank") - pages_per_chunk + 1) / step)).cast("int")
    until = F.least(last, F.floor(F.col("rank") / step).cast("int"))
    held = rows.withColumn("k", F.explode(F.when(first <= until, F.sequence(first, until)).otherwise(F.array().cast("array<int>"))))
    return held.withColumn("chunk_id", F.col("k") + 1).drop("rank", "pages", "k")


def chunk_bounds(chunked: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, start_page, start_line, end_page, end_line, n_lines) of each chunk, by its first and last line."""
    g = F.col("global_line_id")
    return chunked.groupBy("doc_id", "chunk_id").agg(
        F.min_by("page", g).alias("start_page"), F.min_by("line", g).alias("start_line"),
        F.max_by("page", g).alias("end_page"), F.max_by("line", g).alias("end_line"), F.count("*").alias("n_lines"),
    )


def clean_chunks(chunked: DataFrame) -> DataFrame:
    """Chunks' lines without runs of objections and with notes marked.

    Of a run of pure noise the first line stays as [OBJECTION]; a note becomes [PROCEDURAL]; blank lines stay
    and end a run, and so does any other line. Each chunk begins anew.
    """
    text = F.col("text")
    kind = F.when(~T.not_blank(text), "blank").when(T.is_pure_noise(text), "noise").when(T.is_note(text), "note").otherwise("talk")
    rows = chunked.withColumn("kind", kind)
    before = F.lag("kind").over(W.partitionBy("doc_id", "chunk_id").orderBy("global_line_id"))
    rows = rows.withColumn("again", (F.col("kind") == "noise") & F.coalesce(before == "noise", F.lit(False))).where("not again")
    shown = F.when(F.col("kind") == "noise", "[OBJECTION]").when(F.col("kind") == "note", "[PROCEDURAL]").otherwise(text)
    return rows.withColumn("text", shown).drop("kind", "again")


def cleaning_stats(chunked: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(doc_id, tokens_before, tokens_after, reduction_pct): words of all chunks, so overlaps count twice."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.sum(T.word_count(F.col("text"))).cast("long").alias(name))
    both = count(chunked, "tokens_before").join(count(cleaned, "tokens_after"), "doc_id", "left")
    after = F.coalesce("tokens_after", F.lit(0)).cast("long")
    share = F.round(100.0 * (F.col("tokens_before") - after) / F.greatest(F.lit(1), F.col("tokens_before")), 1)
    return both.select("doc_id", "tokens_before", after.alias("tokens_after"), share.alias("reduction_pct"))


def line_keywords(lines: DataFrame) -> DataFrame:
    return lines.withColumn("keywords", T.keywords(F.col("text")))


# --- extraction -------------------------------------------------------------------------------

#: Fixed value: the extractor's instructions.
INSTRUCTIONS = "Return a JSON array of objects with topic, start_page, start_line, end_page, end_line, summary and supporting_quote, for the distinct topics of the testimony in order. Coordinates are those of the tags [P07:L12]; quotes are verbatim; short objections belong to the topic around them."

#: The sentences and labels of a prompt.
PROMPT_CONTEXT = "DEPOSITION CONTEXT:"
PROMPT_LABELS = (("Witness/Deponent", "witness"), ("Case/Matter", "case_name"), ("Examining Attorney", "attorney"), ("Date", "date"))
PROMPT_HEAD = "Analyze this deposition transcript segment (Pages %d to %d):"
PROMPT_END = "Extract all chronological topic segments according to the specified JSON schema."


def prompts(chunked: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_id, start_page, end_page, prompt) of each chunk; empty metadata has no line."""
    g = F.col("global_line_id")
    said = F.when(T.not_blank(F.col("text")), F.struct("global_line_id", T.compact_line(F.col("page"), F.col("line"), F.col("speaker"), F.col("text")).alias("s")))
    # bounds and text in one pass, as chunks aren't kept
    rows = chunked.groupBy("doc_id", "chunk_id").agg(F.min_by("page", g).alias("start_page"), F.max_by("page", g).alias("end_page"), F.array_sort(F.collect_list(said)).alias("said"))
    rows = rows.select("doc_id", "chunk_id", "start_page", "end_page", F.array_join(F.transform("said", lambda r: r["s"]), "\n").alias("compact"))
    head = F.lit("")
    if metadata is not None:
        rows = rows.join(metadata, "doc_id", "left")
        parts = [F.when(F.col(c) != "", F.concat(F.lit(f"  {label}: "), F.col(c))) for label, c in PROMPT_LABELS]
        head = F.concat(F.concat_ws("\n", F.lit(PROMPT_CONTEXT), *parts), F.lit("\n\n"))
    body = F.concat(head, F.format_string(PROMPT_HEAD + "\n\n", "start_page", "end_page"), "compact", F.lit("\n\n" + PROMPT_END))
    return rows.select("doc_id", "chunk_id", "start_page", "end_page", body.alias("prompt"))


def decode_candidates(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Candidate topics from an extractor's JSON text, code fences or not, in order.

    Input: doc_id, chunk_id, start_page, end_page and the answer. Missing fields take the chunk's pages and lines 1 and 25;
    numbers may be given as text. An answer that is no JSON array has no candidates.
    """
    body = T.stripped(F.col(answer_col))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\A```json", ""), r"\A```", ""), r"```\z", "")
    fields = "topic string, start_page string, start_line string, end_page string, end_line string, summary string, supporting_quote string"
    items = F.from_json(T.stripped(body), f"array<struct<{fields.replace(' string', ':string')}>>")
    rows = answers.select("doc_id", "chunk_id", F.col("start_page").alias("sp"), F.col("end_page").alias("ep"), F.posexplode(items).alias("at", "t")).where("t is not null")
    number = lambda c, default: F.coalesce(F.col(c).try_cast("double").cast("int"), default)
    return rows.select(
        "doc_id",
        (F.col("chunk_id").cast("long") * 1_000_000 + F.col("at")).alias("candidate_id"),
        T.stripped(F.coalesce("t.topic", F.lit("Untitled Topic"))).alias("topic"),
        number("t.start_page", F.col("sp")).alias("start_page"),
        number("t.start_line", F.lit(1)).alias("start_line"),
        number("t.end_page", F.col("ep")).alias("end_page"),
        number("t.end_line", F.lit(25)).alias("end_line"),
        F.lit(None).cast("long").alias("start_global_id"),
        F.lit(None).cast("long").alias("end_global_id"),
        T.stripped(F.coalesce("t.summary", F.lit(""))).alias("summary"),
        T.stripped(F.coalesce("t.supporting_quote", F.lit(""))).alias("supporting_quote"),
        F.lit(0.85).alias("confidence"),
        F.lit(False).alias("verified"),
        F.lit(True).alias("needs_human_review"),
    )


def extractor_answers(prompted: DataFrame, extractor: Callable[[str], str] | Sequence[Callable[[str], str]], attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """``prompted`` without the prompt and with the extractor's ``answer`` and an ``error``, chunk by chunk on the executors.

    A call that raises is made again, ``attempts`` times in all, then the next extractor of a sequence is tried in the same way;
    ``pause`` seconds pass after each call. A chunk for which all fail has a null answer and the last error's text, and the
    others have a null error. Spark may run a task again, so a chunk can be asked for more than once.
    """
    order = [extractor] if callable(extractor) else list(extractor)

    def ask(prompt: str) -> tuple[str | None, str | None]:
        error = "no extractor"
        for one in order:
            for _ in range(attempts):
                try:
                    return one(prompt), None
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                finally:
                    time.sleep(pause)
        return None, error

    def answered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [ask(p) for p in frame["prompt"]]
            yield frame.drop(columns="prompt").assign(answer=[a for a, _ in found], error=[e for _, e in found])

    kinds = dict(prompted.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in prompted.columns if c != "prompt") + ", answer string, error string"
    return prompted.mapInPandas(answered, schema)


def prompt_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def known_answers(spark: SparkSession, table: str) -> DataFrame:
    """(key, answer) of the prompts that were answered in earlier runs; of several answers to one, the least."""
    try:
        kept = spark.read.schema("key string, answer string").parquet(table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = spark.createDataFrame([], "key string, answer string")
    return kept.groupBy("key").agg(F.min("answer").alias("answer"))


def resumed_answers(scratch: Scratch, prompted: DataFrame, extractor: Callable[[str], str] | Sequence[Callable[[str], str]], table: str, attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """As ``extractor_answers``, but only prompts without an answer in ``table`` are asked, each once, and their answers are added to it.

    The table (Parquet: the prompt's hash and the answer) outlives the run, so that one that failed asks for what is missing only, and
    documents that repeat are asked for once. Failures aren't kept. New answers are written before this returns.
    """
    keyed = scratch.keep(prompted.withColumn("key", prompt_key(F.col("prompt"))), "prompts")
    before = known_answers(scratch.spark, table)
    asked = keyed.select("key", "prompt").dropDuplicates(["key"]).join(before.select("key"), "key", "left_anti")
    made = scratch.keep(extractor_answers(asked, extractor, attempts, pause), "made")
    made.where("error is null and answer is not null").select("key", "answer").write.mode("append").parquet(table)
    both = before.select("key", "answer", F.lit(None).cast("string").alias("error")).union(made.select("key", "answer", "error"))
    once = both.groupBy("key").agg(F.min("answer").alias("answer"), F.min("error").alias("error"))
    error = F.when(F.col("answer").isNull(), F.col("error"))
    return keyed.drop("prompt").join(once, "key", "left").drop("key").withColumn("error", error)


def extract_candidates(prompted: DataFrame, extractor: Callable[[str], str]) -> DataFrame:
    """Candidates by an extractor: prompt in, JSON text out. Chunks whose calls fail have no candidates; ``extractor_answers`` tells which."""
    return decode_candidates(extractor_answers(prompted, extractor))


def block_candidates(lines: DataFrame, lines_per_topic: int = 7, spread: Callable[[Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """Candidates without an extractor: one for each block of lines, labelled by the first line's first three keywords and
    quoting that line. ``spread`` gives how many lines the start is moved and how many more lines there are, by document."""
    k = F.floor((F.col("global_line_id") - 1) / lines_per_topic).cast("long")
    move, more = spread(F.col("doc_id")) if spread else (F.lit(0), F.lit(lines_per_topic - 1))
    start = F.col("global_line_id") + move
    end = start + more
    page, line = (lambda g: (F.floor((g - 1) / 25) + 1).cast("int")), (lambda g: ((g - 1) % 25 + 1).cast("int"))
    rows = lines.where((F.col("global_line_id") - 1) % lines_per_topic == 0).select(
        "doc_id",
        k.alias("candidate_id"),
        F.array_join(F.slice(T.keywords(F.col("text")), 1, 3), " ").alias("topic"),
        page(start).alias("start_page"),
        line(start).alias("start_line"),
        page(end).alias("end_page"),
        line(end).alias("end_line"),
        F.lit(None).cast("long").alias("start_global_id"),
        F.lit(None).cast("long").alias("end_global_id"),
        F.format_string("Lines %d to %d", start.cast("long"), end.cast("long")).alias("summary"),
        F.col("text").alias("supporting_quote"),
        F.lit(0.85).alias("confidence"),
        F.lit(False).alias("verified"),
        F.lit(True).alias("needs_human_review"),
    )
    return rows


assert [c.split()[0] for c in TOPICS.split(", ")][:2] == ["doc_id", "candidate_id"]
