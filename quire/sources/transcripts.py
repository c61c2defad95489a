"""Sources: plain documents, conversations, page texts with blocks, result files and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.schemas import LINES_PER_PAGE, TOPICS

#: What marks the end of testimony.
CERTIFICATES = ("CERTIFICATE OF CERTIFIED SHORTHAND", "CERTIFICATION OF CERTIFIED SHORTHAND")
STOP_MARKERS = (*CERTIFICATES, "CERTIFICATE OF REPORTER", "WORD INDEX", "CONCORDANCE")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, modificationTime, length, content); a missing path raises when it is planned."""
    return spark.read.format("binaryFile").load(path)


def pdf_pages(files: DataFrame, extract) -> DataFrame:
    """Page texts of binary files by ``extract(bytes) -> [(text, [block, ...]), ...]``, which may use any PDF library.

    One row of ``path`` each; files are read where they are, and no library is needed unless this is called.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                pages = list(extract(bytes(content)))
                yield pd.DataFrame({"path": [path] * len(pages), "page_idx": range(len(pages)), "text": [p[0] for p in pages], "blocks": [list(p[1]) for p in pages]})

    return files.select("path", "content").mapInPandas(run, "path string, page_idx int, text string, blocks array<string>")


def grid_of_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, global_line_id, page, line, text): a text's lines on pages of 25, in order; null texts and ids have none.

    An id has to be unique, as coordinates are within it; ``unique_documents`` makes it so.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "text"))
    return rows.select(
        "doc_id",
        (F.col("pos") + 1).cast("long").alias("global_line_id"),
        (F.floor(F.col("pos") / LINES_PER_PAGE) + 1).cast("int").alias("page"),
        (F.col("pos") % LINES_PER_PAGE + 1).cast("int").alias("line"),
        "text",
    )


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with an id, one for each: of several, one with the smallest text (nulls last)."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = W.partitionBy("id").orderBy(F.col("text").asc_nulls_last())
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("row.*")


def grid_of_turns(turns: DataFrame) -> DataFrame:
    """(doc_id, global_line_id, page, line, new_speaker, text): turns' lines, the role on the first of each turn.

    Turns without a conversation have none; turns of one number follow each other by role and text.
    """
    turns = turns.where(F.col("conv_id").isNotNull())
    rows = turns.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("whole", F.xxhash64("text")).select("whole", "conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    gid = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "whole", "pos"))
    rows = rows.withColumn("gid", gid)
    return rows.select(
        F.col("conv_id").alias("doc_id"),
        F.col("gid").cast("long").alias("global_line_id"),
        (F.floor((F.col("gid") - 1) / LINES_PER_PAGE) + 1).cast("int").alias("page"),
        ((F.col("gid") - 1) % LINES_PER_PAGE + 1).cast("int").alias("line"),
        F.when(F.col("pos") == 0, F.upper("role")).alias("new_speaker"),
        "text",
    )


def printed_page(text: Column, page_idx: Column) -> Column:
    """The last "Page n" of a page's text, else its place in the file."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)Page\s+(\d+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)).try_cast("int"), page_idx + 1)


def scan_pages(pages: DataFrame, start_page: int | Column, end_page: int | Column) -> DataFrame:
    """Pages whose printed number is in the range, before the first one with a certificate.

    Only the first ``end_page`` + 5 pages of a file are looked at.
    """
    start_page, end_page = (c if isinstance(c, Column) else F.lit(c) for c in (start_page, end_page))
    marked = F.lit(False)
    for marker in CERTIFICATES:
        marked = marked | F.upper("text").contains(marker)
    stop = F.min(F.when(marked, F.col("page_idx"))).over(W.partitionBy("doc_id"))
    seen = pages.where(F.col("page_idx") < end_page + 5).withColumn("stop", stop)
    kept = seen.where(F.col("stop").isNull() | (F.col("page_idx") < F.col("stop"))).withColumn("page", printed_page(F.col("text"), F.col("page_idx")))
    return kept.where(F.col("page").between(start_page, end_page)).drop("stop")


def block_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_idx, page, line, content) from text blocks whose first token is a line number.

    Blocks that begin with a page footer are passed over; of two blocks with one number the later one stays.
    """
    blocks = pages.select("doc_id", "page_idx", "page", F.posexplode("blocks").alias("at", "block"))
    blocks = blocks.withColumn("block", T.stripped(F.col("block"))).where(~F.col("block").rlike(r"(?i)^Page\s+(\d+)"))
    parts = F.filter(F.transform(F.split("block", "\n"), T.stripped), lambda p: p != "")
    blocks = blocks.withColumn("parts", parts)
    first = F.try_element_at("parts", F.lit(1))
    number = F.when(first.rlike(r"^\d+$"), first.try_cast("int"))
    blocks = blocks.withColumn("line", number).where(F.col("line").between(1, LINES_PER_PAGE))
    content = F.array_join(F.slice("parts", F.lit(2), F.size("parts")), " ")
    return blocks.groupBy("doc_id", "page_idx", "page", "line").agg(F.max_by(content, "at").alias("content"))


def densify(pages: DataFrame, cells: DataFrame) -> DataFrame:
    """Lines 1 to 25 of each page (doc_id, page_idx, page); what ``cells`` doesn't have has empty content."""
    grid = pages.select("doc_id", "page_idx", "page").withColumn("line", F.explode(F.sequence(F.lit(1), F.lit(LINES_PER_PAGE))))
    full = grid.join(cells.select("doc_id", "page_idx", "line", "content"), ["doc_id", "page_idx", "line"], "left")
    return full.select("doc_id", "page_idx", "page", "line", F.coalesce("content", F.lit("")).alias("content"))


def dense_block_lines(pages: DataFrame) -> DataFrame:
    """``densify`` of ``block_lines``, page by page where the blocks are, so that no line is shuffled; a row is a page."""
    footer = lambda b: b.rlike(r"(?i)^Page\s+(\d+)")
    whole = F.filter(F.transform("blocks", T.stripped), lambda b: ~footer(b))
    parts = F.transform(whole, lambda b: F.filter(F.transform(F.split(b, "\n"), T.stripped), lambda p: p != ""))

    def cell(p: Column) -> Column:
        first = F.try_element_at(p, F.lit(1))
        return F.struct(F.when(first.rlike(r"^\d+$"), first.try_cast("int")).alias("line"), F.array_join(F.slice(p, F.lit(2), F.size(p)), " ").alias("content"))

    def dense(cells: Column) -> Column:
        last = lambda k: F.try_element_at(F.filter(cells, lambda c: c["line"] == k), F.lit(-1))["content"]
        return F.transform(F.sequence(F.lit(1), F.lit(LINES_PER_PAGE)), lambda k: F.struct(k.alias("line"), F.coalesce(last(k), F.lit("")).alias("content")))

    rows = F.element_at(F.transform(F.array(F.transform(parts, cell)), dense), 1)
    return pages.select("doc_id", "page_idx", "page", F.explode(rows).alias("r")).select("doc_id", "page_idx", "page", "r.line", "r.content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The topics of result files, one row each, with the file as ``path``."""
    fields = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in TOPICS.split(", ")[2:])
    schema = f"title string, witness string, date string, case_name string, total_pages int, total_lines int, topics array<struct<{fields}>>"
    files = spark.read.schema(schema).json(path, multiLine=True).select(F.input_file_name().alias("path"), "title", "witness", "date", "case_name", F.posexplode("topics").alias("at", "t"))
    return files.select("path", "title", "witness", "date", "case_name", F.col("at").cast("long").alias("candidate_id"), "t.*")


def read_viewer(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, witness, date, caseName, topics, lines) of viewer scripts: an assignment of one JSON object each."""
    topic = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in TOPICS.split(", ")[2:])
    line = "global_id: long, page: int, line: int, speaker: string, text: string, timestamp: string"
    schema = f"title string, witness string, date string, caseName string, topics array<struct<{topic}>>, lines array<struct<{line}>>"
    body = F.regexp_replace(F.regexp_replace("value", r"^\s*window\.[A-Za-z_]+\s*=\s*", ""), r";\s*$", "")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json(body, schema).alias("v")).select("path", "v.*")


def safe_upload_name(name: Column) -> Column:
    """Letters, digits, and "._- " of a name, with ".pdf" at the end."""
    kept = F.regexp_replace(name, r"[^\p{L}\p{N}._\- ]", "")
    return F.when(F.lower(kept).endswith(".pdf"), kept).otherwise(F.concat(kept, F.lit(".pdf")))
