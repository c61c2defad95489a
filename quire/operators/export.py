"""Results as JSON, Markdown, HTML, a viewer bundle and reports. Rows and files are made by Spark, and written by its executors."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions import text as T
from quire.operators.evaluate import numbered
from quire.sources.files import write_files

TOPIC_FIELDS = ("topic", "start_page", "start_line", "end_page", "end_line", "start_global_id", "end_global_id", "summary", "supporting_quote", "confidence", "verified", "needs_human_review")

#: The head of the Markdown table.
MARKDOWN_HEAD = ("| # | Topic | Start Coordinate | End Coordinate | Summary | Supporting Quote | Verified |", "|---|---|---|---|---|---|:---:|")
UNKNOWN = "unknown"


def topic_json(options: dict | None = None) -> Column:
    """A topic's JSON object; nulls stay."""
    return F.to_json(F.struct(*TOPIC_FIELDS), options or {"ignoreNullFields": "false"})


def json_rows(topics: DataFrame) -> DataFrame:
    return numbered(topics).select("doc_id", "num", topic_json().alias("json"))


def topic_index(topics: DataFrame, lines: DataFrame, report: DataFrame, about: DataFrame | None = None, model: str = "none") -> DataFrame:
    """One row of each document: title, witness, date, case_name, totals, topics in order and metadata."""
    rows = numbered(topics).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("num", F.struct(*TOPIC_FIELDS).alias("t")))).alias("r"), F.count_if("verified").alias("n_verified"))
    rows = rows.withColumn("topics", F.transform("r", lambda r: r["t"])).drop("r")
    size = lines.groupBy("doc_id").agg(F.count_distinct("page").cast("int").alias("total_pages"), F.count("*").cast("int").alias("total_lines"))
    facts = report.select("doc_id", "coverage_percentage", F.size("uncovered_segments").alias("uncovered_gaps_count"), "has_critical_omissions")
    out = size.join(rows, "doc_id", "left").join(facts, "doc_id", "left")
    out = out.join(about, "doc_id", "left") if about is not None else out.withColumns({c: F.lit("") for c in ("witness", "date", "case_name")})
    metadata = F.struct(F.lit(model).alias("model"), F.coalesce("n_verified", F.lit(0)).alias("verified_count"), "coverage_percentage", "uncovered_gaps_count", "has_critical_omissions")
    kind = dict(rows.dtypes)["topics"]
    return out.select("doc_id", F.concat(F.lit("Deposition of "), F.coalesce(F.nullif("witness", F.lit("")), F.lit(UNKNOWN))).alias("title"), "witness", "date", "case_name", "total_pages", "total_lines", F.coalesce("topics", F.array().cast(kind)).alias("topics"), metadata.alias("metadata"))


def _cell(c: str) -> Column:
    return F.replace(F.replace(F.col(c), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))


def markdown_rows(topics: DataFrame) -> DataFrame:
    """(doc_id, num, row) of the Markdown table."""
    quote = _cell("supporting_quote")
    shown = F.when(quote != "", F.concat(F.lit('*"'), F.substring(quote, 1, 100), F.lit('..."*'))).otherwise("*(No quote)*")
    cells = (F.col("num").cast("string"), F.concat(F.lit("**"), F.col("topic"), F.lit("**")), T.coordinate(F.col("start_page"), F.col("start_line")), T.coordinate(F.col("end_page"), F.col("end_line")), _cell("summary"), shown, F.when(F.col("verified"), "✅").otherwise("⚠️"))
    return numbered(topics).select("doc_id", "num", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))


def escaped(c: Column) -> Column:
    """Text for HTML; the ampersand goes first."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_rows(topics: DataFrame) -> DataFrame:
    """(doc_id, num, row): a table row of each topic, its texts escaped."""
    kind = F.when(F.col("verified"), "verified").otherwise("unverified")
    badge = F.concat(F.when(F.col("verified"), "Verified").otherwise("Review"), F.lit(" ("), F.floor(F.col("confidence") * 100 + 1e-9).cast("string"), F.lit("%)"))
    cells = (F.col("num").cast("string"), escaped(F.col("topic")), T.coordinate(F.col("start_page"), F.col("start_line")), T.coordinate(F.col("end_page"), F.col("end_line")), escaped(F.col("summary")), F.concat(F.lit("&ldquo;"), escaped(F.col("supporting_quote")), F.lit("&rdquo;")), F.concat(F.lit('<span class="badge badge-'), kind, F.lit('">'), badge, F.lit("</span>")))
    return numbered(topics).select("doc_id", "num", F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>")).alias("row"))


def viewer_bundle(index: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, bundle): the viewer's JSON object of each document, with its topics and lines."""
    line = F.struct(F.col("global_line_id").alias("global_id"), "page", "line", "speaker", "text", "timestamp")
    said = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    both = index.join(said, "doc_id", "left")
    return both.select("doc_id", F.to_json(F.struct("title", "witness", "date", F.col("case_name").alias("caseName"), "topics", "lines"), {"ignoreNullFields": "false"}).alias("bundle"))


def api_response(index: DataFrame, lines: DataFrame, filename: Column) -> DataFrame:
    """(doc_id, response): what an upload is answered with."""
    pages = lines.groupBy("doc_id").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    rows = viewer_bundle(index, lines).join(index.select("doc_id", "total_lines"), "doc_id").join(pages, "doc_id", "left")
    page_range = F.format_string("%d-%d", "a", "b")
    head = F.to_json(F.struct(F.lit(True).alias("success"), filename.alias("filename"), page_range.alias("pageRange"), F.col("total_lines").alias("totalLines")))
    return rows.select("doc_id", F.concat(F.regexp_replace(head, r"\}$", ","), F.substring(F.col("bundle"), 2, 2**31 - 1)).alias("response"))


@F.pandas_udf(StringType())
def indented(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON text again, two spaces a level and in ASCII."""
    for v in values:
        yield v.map(lambda s: None if s is None else json.dumps(json.loads(s), indent=2))


#: The style and the columns of the HTML page.
STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse;width:100%}td,th{border-bottom:1px solid #ddd;padding:8px;text-align:left}.badge-verified{background:lightcyan}.badge-unverified{background:mistyrose}"
HTML_COLUMNS = ("#", "Topic", "Start", "End", "Summary", "Supporting Quote", "Status")


def document_files(topics: DataFrame, index: DataFrame, base: str = "topic_index", raw: DataFrame | None = None) -> DataFrame:
    """(doc_id, name, content): each document's JSON, Markdown and HTML, and its ``raw`` candidates if given, as files of one base name."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(UNKNOWN))
    gathered = lambda df, name: df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("num", "row"))), lambda r: r["row"]).alias(name))
    rows = index.join(gathered(markdown_rows(topics), "md"), "doc_id", "left").join(gathered(html_rows(topics), "html"), "doc_id", "left")
    none = F.array().cast("array<string>")
    md, html = F.coalesce("md", none), F.coalesce("html", none)
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    pages, lines = F.col("total_pages"), F.col("total_lines")
    head = [
        text("# ", F.col("title")), text("**Deponent / Witness:** ", known("witness"), "  "), text("**Date:** ", known("date"), "  "),
        text("**Total Substantive Pages:** ", pages, " (Total Lines: ", lines, ")  "), text("**Total Topics Identified:** ", F.size(md), "  "),
        *map(F.lit, ("", "---", "", *MARKDOWN_HEAD)),
    ]
    names = "".join(f"<th>{n}</th>" for n in HTML_COLUMNS)
    page = text(
        '<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><title>', F.col("title"), f"</title><style>{STYLE}</style></head><body><h1>", F.col("title"), "</h1><p>Witness: ", known("witness"), " | Date: ", known("date"),
        " | Pages: ", pages, " (Lines: ", lines, ") | Topics: ", F.size(html), f"</p><table><thead><tr>{names}</tr></thead><tbody>\n", F.array_join(html, "\n"), "\n</tbody></table></body></html>\n",
    )
    fields = [c for c in index.columns if c != "doc_id"]
    found = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    files = [(f"{base}.json", indented(found)), (f"{base}.md", F.array_join(F.concat(F.array(*head), md), "\n")), (f"{base}.html", page)]
    out = rows.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("content")) for n, c in files))).alias("f")).select("doc_id", "f.*")
    if raw is not None:
        kept = raw.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("candidate_id", F.struct(*TOPIC_FIELDS).alias("t")))).alias("r"))
        listed = F.to_json(F.transform("r", lambda r: r["t"]), {"ignoreNullFields": "false"})
        out = out.union(kept.select("doc_id", F.lit(f"{base}_raw.json"), indented(listed)))
    return out


def export_documents(topics: DataFrame, index: DataFrame, folder: str, base: str = "topic_index", raw: DataFrame | None = None) -> None:
    """Writes the files of all documents, each in the folder of its id, from the executors (see ``quire.sources.files``)."""
    files = document_files(topics, index, base, raw)
    write_files(files.select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("name")).alias("path"), "content"), folder)


def export_document(topics: DataFrame, index: DataFrame, doc_id: int, folder: str, base: str = "topic_index", raw: DataFrame | None = None) -> list[str]:
    """Writes one document's files into a folder; returns the paths."""
    one = lambda df: df.where(F.col("doc_id") == doc_id)
    files = document_files(one(topics), one(index), base, None if raw is None else one(raw))
    write_files(files.select(F.col("name").alias("path"), "content"), folder)
    return [os.path.join(folder, f"{base}{end}") for end in (".json", ".md", ".html", *([] if raw is None else ["_raw.json"]))]


def export_viewers(bundle: DataFrame, folder: str) -> None:
    """Writes each document's viewer script, named by its id."""
    write_files(bundle.select(F.concat(F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), _script()), folder)


def _script() -> Column:
    return F.concat(F.lit("window.DEPOSITION_DATA = "), F.col("bundle"), F.lit(";\n")).alias("content")


def write_viewer(bundle: DataFrame, doc_id: int, path: str) -> None:
    folder, name = os.path.split(path)
    write_files(bundle.where(F.col("doc_id") == doc_id).select(F.lit(name).alias("path"), _script()), folder)


def evaluation_report(matrix: DataFrame, means: DataFrame, doc_id: int) -> str:
    """A Markdown report of one document's sample."""
    rows = matrix.where(F.col("doc_id") == doc_id).orderBy("num").collect()
    m = means.where(F.col("doc_id") == doc_id).first()
    out = ["# Validation report", "", f"- Sampled: {m['sampled']}", f"- Location accuracy: {m['avg_location']} %", f"- Relevance: {m['avg_relevance']} %", f"- Boundary quality: {m['avg_boundary']} %", "", "| # | Topic | Range | Location | Quote |", "|---|---|---|---|---|"]
    return "\n".join(out + [f"| {r['num']} | {r['topic']} | {r['range']} | {'Pass' if r['location'] else 'Fail'} | {r['quote']} |" for r in rows])


def stability_report(stability: DataFrame, doc_id: int) -> str:
    r = stability.where(F.col("doc_id") == doc_id).first()
    return "\n".join(["# Stability report", "", f"- Runs: {r['runs']}", f"- Topic count variance: {r['count_variance']}", f"- Mean label similarity: {int(100 * (r['mean_similarity'] or 0))} %"])
