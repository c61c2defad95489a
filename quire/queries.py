"""Queries over the driver's tables, and the same in DuckDB's SQL.

Documents are transcripts of 25 lines a page. Candidate topics need no extractor: each block of seven lines is one, its
coordinates moved by the document's number so that drift, missing ends and inversions occur.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import audit, chunks, evaluate, export, layout, lines, merge, validate
from quire.plans import indexing
from quire.sources import transcripts
from quire.storage import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, whole numbers as longs."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in df.dtypes))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- shared parts, in Spark and in SQL ----------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(spark, sf_dir):
    return transcripts.grid_of_text(_table(spark, sf_dir, "documents"))


def _lines(spark, sf_dir):
    return indexing.lines_of_text(_table(spark, sf_dir, "documents"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A table of what several parts of a plan read."""
    return Scratch(df.sparkSession, "query").keep(df, name)


def _topics(spark, sf_dir, grid: DataFrame | None = None):
    rows = chunks.block_candidates(_grid(spark, sf_dir) if grid is None else grid, 7, lambda d: (d % 3, d % 5 + 3))
    k = F.col("doc_id") + F.col("candidate_id")
    back = k % 11 == 0
    swap = lambda a, b: F.when(back, F.col(b)).otherwise(F.col(a))
    rows = rows.withColumn("topic", F.when(k % 5 == 0, "Attorney Objection").otherwise(F.col("topic")))
    return rows.withColumns({"start_page": swap("start_page", "end_page"), "end_page": swap("end_page", "start_page"), "start_line": swap("start_line", "end_line"), "end_line": swap("end_line", "start_line")})


def _noisy(spark, sf_dir):
    at = F.col("global_line_id") % 7
    text = F.when(at == 1, "Objection. Form.").when(at == 2, "Objection, hearsay").when(at == 3, "(Recess taken from 10:30 a.m.)").when(at == 4, "").otherwise(F.col("text"))
    return _grid(spark, sf_dir).withColumn("text", text)


def _pages(spark, sf_dir):
    """Page texts and blocks as a reader of files would give them, with title pages, indexes, questions and certificates."""
    rows = _grid(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("r"))
    d, p = F.col("doc_id"), F.col("page")
    body = F.array_join(F.transform("r", lambda r: F.concat(r["line"].cast("string"), F.lit(" "), r["text"])), "\n")
    head = F.when((p == 1) & (d % 2 == 0), "DEPOSITION OF JANE DOE-SMITH\nTaken March 3rd, 2021\nBY MS. LEE\nmatter of Alpha Co vs. Beta LLC;\n").otherwise("")
    head = F.concat(head, F.when((p == 1) & (d % 4 == 0), "INDEX\nEXAMINATION BY MS. LEE ..... 9\n").otherwise(""))
    head = F.concat(head, F.when((p == 2) & (d % 3 == 0), "12 Q. And then?\n").otherwise(""))
    head = F.concat(head, F.when((p == 4) & (d % 5 == 0), "CERTIFICATE OF CERTIFIED SHORTHAND REPORTER\n").otherwise(""))
    foot = F.when(d % 7 == 0, "").otherwise(F.concat(F.lit("\nPage "), (p + 6).cast("string")))
    blocks = F.concat(F.transform("r", lambda r: F.concat(F.lit(" "), r["line"].cast("string"), F.lit("\n"), r["text"], F.lit(" "))), F.array(F.lit("Page 99\n3\nfooter"), F.lit("3\nlast one\nwins"), F.lit("x 4\nno number")))
    return rows.select("doc_id", (p - 1).cast("int").alias("page_idx"), F.concat(head, body, foot).alias("text"), blocks.alias("blocks"))


_STOP = "[" + ",".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _kw(x: str) -> str:
    return f"[w FOR w IN regexp_extract_all(lower({x}), '[a-z]+') IF len(w) > 2 AND NOT list_contains({_STOP}, w)]"


def _norm(x: str) -> str:
    return f"regexp_replace(lower(regexp_replace({x}, '[^a-zA-Z0-9\\s]', '', 'g')), '^\\s+|\\s+$', '', 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


GRID = """grid AS (
  SELECT doc_id, CAST(i AS BIGINT) AS global_line_id, CAST((i - 1) // 25 + 1 AS BIGINT) AS page, CAST((i - 1) % 25 + 1 AS BIGINT) AS line, parts[i] AS text
  FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
)"""
TOPICS = f"""raw_topics AS (
  SELECT doc_id, (global_line_id - 1) // 7 AS candidate_id, array_to_string(({_kw("text")})[1:3], ' ') AS label, text,
         global_line_id + doc_id % 3 AS s, global_line_id + doc_id % 3 + doc_id % 5 + 3 AS e FROM grid WHERE (global_line_id - 1) % 7 = 0
), topics AS (
  SELECT doc_id, candidate_id, CASE WHEN (doc_id + candidate_id) % 5 = 0 THEN 'Attorney Objection' ELSE label END AS topic,
         (f - 1) // 25 + 1 AS start_page, (f - 1) % 25 + 1 AS start_line, (t - 1) // 25 + 1 AS end_page, (t - 1) % 25 + 1 AS end_line,
         'Lines ' || s || ' to ' || e AS summary, text AS supporting_quote, CAST(0.85 AS DOUBLE) AS confidence
  FROM (SELECT *, CASE WHEN (doc_id + candidate_id) % 11 = 0 THEN e ELSE s END AS f, CASE WHEN (doc_id + candidate_id) % 11 = 0 THEN s ELSE e END AS t FROM raw_topics)
)"""
NOISY = """noisy AS (
  SELECT doc_id, global_line_id, page, line, CASE global_line_id % 7 WHEN 1 THEN 'Objection. Form.' WHEN 2 THEN 'Objection, hearsay'
         WHEN 3 THEN '(Recess taken from 10:30 a.m.)' WHEN 4 THEN '' ELSE text END AS text FROM grid
)"""
CHUNKED = """ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS r, max(page) OVER (PARTITION BY doc_id) AS n FROM {source}
), chunked AS (
  SELECT doc_id, k + 1 AS chunk_id, global_line_id, page, line, text
  FROM (SELECT *, unnest(generate_series(greatest(0, r - 1), least(CASE WHEN n <= 2 THEN 0 ELSE n - 2 END, r))) AS k FROM ranked)
)"""
PAGES = """pages_of AS (
  SELECT doc_id, page - 1 AS page_idx,
    (CASE WHEN page = 1 AND doc_id % 2 = 0 THEN 'DEPOSITION OF JANE DOE-SMITH' || chr(10) || 'Taken March 3rd, 2021' || chr(10) || 'BY MS. LEE' || chr(10) || 'matter of Alpha Co vs. Beta LLC;' || chr(10) ELSE '' END)
    || (CASE WHEN page = 1 AND doc_id % 4 = 0 THEN 'INDEX' || chr(10) || 'EXAMINATION BY MS. LEE ..... 9' || chr(10) ELSE '' END)
    || (CASE WHEN page = 2 AND doc_id % 3 = 0 THEN '12 Q. And then?' || chr(10) ELSE '' END)
    || (CASE WHEN page = 4 AND doc_id % 5 = 0 THEN 'CERTIFICATE OF CERTIFIED SHORTHAND REPORTER' || chr(10) ELSE '' END)
    || string_agg(line || ' ' || text, chr(10) ORDER BY line)
    || (CASE WHEN doc_id % 7 = 0 THEN '' ELSE chr(10) || 'Page ' || (page + 6) END) AS text
  FROM grid GROUP BY doc_id, page
), printed AS (
  SELECT *, coalesce(TRY_CAST(list_extract(regexp_extract_all(text, '(?i)Page\\s+(\\d+)', 1), -1) AS BIGINT), page_idx + 1) AS page FROM pages_of
)"""


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " " + select


# --- grid and lines -------------------------------------------------------------------------------


@query(_with(GRID, select="SELECT * FROM grid"))
def grid_lines(spark, sf_dir):
    return _grid(spark, sf_dir)


@query(_with(GRID, select="SELECT p.doc_id, p.page, l.line, coalesce(g.text, '') AS text FROM (SELECT DISTINCT doc_id, page FROM grid) p CROSS JOIN (SELECT CAST(unnest(generate_series(1, 25)) AS BIGINT) AS line) l LEFT JOIN grid g ON g.doc_id = p.doc_id AND g.page = p.page AND g.line = l.line"))
def grid_dense25(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    pages = grid.select("doc_id", "page").distinct().withColumn("page_idx", F.col("page") - 1)
    cells = grid.select("doc_id", (F.col("page") - 1).alias("page_idx"), "line", F.col("text").alias("content"))
    return transcripts.densify(pages, cells).select("doc_id", "page", "line", F.col("content").alias("text"))


_TURNS = """turn_lines AS (
  SELECT conv_id, turn, role, i, parts[i] AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS gid
  FROM (SELECT conv_id, turn, role, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS parts FROM conversations))
)"""
_SPEAKER = r"(?i)^(?:BY\s+)?(MR\.\s+[A-Z]+|MS\.\s+[A-Z]+|THE\s+WITNESS|THE\s+REPORTER|THE\s+VIDEOGRAPHER|THE\s+COURT)[\.:\s]*(.*)"
_LETTER = r"(?i)^(?:BY\s+)?([QA])(?:$|[^\p{L}\p{N}_])"
_PARSE = f"""cells AS (
  SELECT conv_id AS doc_id, gid, (CASE WHEN i = 1 THEN CASE role WHEN 'user' THEN 'Q. ' WHEN 'assistant' THEN 'A: ' ELSE 'The Reporter: ' END ELSE '' END) || text
         || (CASE WHEN gid % 5 = 0 THEN ' 0' || (gid % 10) || ':1' || (gid % 7) ELSE '' END) AS content FROM turn_lines
), plain AS (
  SELECT doc_id, gid, content, nullif(regexp_extract(content, '(\\d{{2}}:\\d{{2}})\\s*$', 1), '') AS timestamp, {_strip("regexp_replace(content, '(\\d{2}:\\d{2})\\s*$', '')")} AS p FROM cells
), parsed AS (
  SELECT doc_id, gid, timestamp,
    CASE WHEN regexp_matches(p, '{_SPEAKER}') THEN upper(regexp_extract(p, '{_SPEAKER}', 1))
         WHEN regexp_matches(p, '{_LETTER}') THEN CASE upper(regexp_extract(p, '{_LETTER}', 1)) WHEN 'Q' THEN 'QUESTION (LEE)' ELSE 'ANSWER (DOE)' END END AS new_speaker,
    CASE WHEN regexp_matches(p, '{_SPEAKER}') THEN {_strip(f"regexp_extract(p, '{_SPEAKER}', 2)")}
         WHEN regexp_matches(p, '{_LETTER}') THEN {_strip("regexp_replace(p, '(?i)^(?:BY\\s+)?[QA][\\.:\\s]*', '')")} ELSE p END AS text FROM plain
)"""


def _cells(spark, sf_dir):
    turns = transcripts.grid_of_turns(_table(spark, sf_dir, "conversations"))
    role = F.when(F.col("new_speaker") == "USER", "Q. ").when(F.col("new_speaker") == "ASSISTANT", "A: ").when(F.col("new_speaker").isNotNull(), "The Reporter: ").otherwise("")
    g = F.col("global_line_id")
    stamp = F.when(g % 5 == 0, F.concat(F.lit(" 0"), (g % 10).cast("string"), F.lit(":1"), (g % 7).cast("string"))).otherwise("")
    return turns.select("doc_id", F.col("page").alias("page_idx"), "page", "line", F.concat(role, "text", stamp).alias("content"))


@query(_with(_TURNS, _PARSE, select="SELECT doc_id, gid AS global_line_id, coalesce(last_value(new_speaker IGNORE NULLS) OVER w, CASE WHEN max(CASE WHEN text <> '' THEN 1 ELSE 0 END) OVER w = 1 THEN 'EXAMINATION' END, '') AS speaker, text, timestamp FROM parsed WINDOW w AS (PARTITION BY doc_id ORDER BY gid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def line_parse(spark, sf_dir):
    return lines.parse_cells(_cells(spark, sf_dir), "LEE", "DOE").select("doc_id", "global_line_id", "speaker", "text", "timestamp")


@query(_with(_TURNS, _PARSE, select="SELECT doc_id, gid AS global_line_id, coalesce(last_value(new_speaker IGNORE NULLS) OVER w, CASE WHEN max(CASE WHEN text <> '' THEN 1 ELSE 0 END) OVER w = 1 THEN 'EXAMINATION' END, '') AS speaker, text, timestamp FROM parsed WINDOW w AS (PARTITION BY doc_id ORDER BY gid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def line_parse_ranges(spark, sf_dir):
    """As ``line_parse``, in ranges that cut documents."""
    return lines.parse_cells(_cells(spark, sf_dir), "LEE", "DOE", Scratch(spark, "query")).select("doc_id", "global_line_id", "speaker", "text", "timestamp")


@query(_with(_TURNS, select="SELECT conv_id AS doc_id, gid AS global_line_id, coalesce(last_value(CASE WHEN i = 1 AND role <> 'system' THEN upper(role) END IGNORE NULLS) OVER w, CASE WHEN max(CASE WHEN text <> '' THEN 1 ELSE 0 END) OVER w = 1 THEN 'EXAMINATION' END, '') AS speaker FROM turn_lines WINDOW w AS (PARTITION BY conv_id ORDER BY gid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def speaker_fill(spark, sf_dir):
    turns = transcripts.grid_of_turns(_table(spark, sf_dir, "conversations"))
    new = F.when(F.col("new_speaker") != "SYSTEM", F.col("new_speaker"))
    return turns.select("doc_id", "global_line_id", lines.continued_speaker(new, F.col("text")).alias("speaker"))


@query(_with(GRID, select="SELECT doc_id, string_agg(format('[P{:02d}:L{:02d}] EXAMINATION: {}', page, line, text), chr(10) ORDER BY global_line_id) AS compact FROM (SELECT *, max(CASE WHEN text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY global_line_id) AS said FROM grid) WHERE trim(text) <> '' GROUP BY doc_id"))
def compact_text(spark, sf_dir):
    return lines.compact_text(_lines(spark, sf_dir))


@query(_with(GRID, select="SELECT doc_id, page, count(*) AS n_lines, min(line) AS first_line, max(line) AS last_line FROM grid GROUP BY doc_id, page"))
def page_groups(spark, sf_dir):
    return lines.page_groups(_grid(spark, sf_dir))


# --- pages ------------------------------------------------------------------------------------------


@query(_with(GRID, PAGES, select="SELECT doc_id, page_idx, page FROM printed"))
def printed_pages(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", "page_idx", transcripts.printed_page(F.col("text"), F.col("page_idx")).alias("page"))


@query(_with(GRID, PAGES, select="SELECT doc_id, page_idx, page FROM (SELECT *, min(CASE WHEN contains(upper(text), 'CERTIFICATE OF CERTIFIED SHORTHAND') OR contains(upper(text), 'CERTIFICATION OF CERTIFIED SHORTHAND') THEN page_idx END) OVER (PARTITION BY doc_id) AS stop FROM printed WHERE page_idx < 14) WHERE (stop IS NULL OR page_idx < stop) AND page BETWEEN 2 AND 9"))
def page_range_scan(spark, sf_dir):
    return transcripts.scan_pages(_pages(spark, sf_dir), 2, 9).select("doc_id", "page_idx", "page")


@query(_with(GRID, select="SELECT doc_id, page, line, CASE WHEN line = 3 THEN 'last one wins' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS content FROM grid UNION ALL SELECT doc_id, page, 3 AS line, 'last one wins' AS content FROM grid GROUP BY doc_id, page HAVING max(line) < 3"))
def block_cells(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("page", F.col("page_idx") + 1)
    return transcripts.block_lines(pages).select("doc_id", "page", "line", "content")


@query(_with(GRID, PAGES, select=r"""SELECT doc_id,
  coalesce(cited, asked, 7) AS start_page, coalesce(CASE WHEN cited IS NOT NULL OR asked IS NOT NULL THEN last END, 88) AS end_page FROM (
  SELECT doc_id, arg_min(cited, page_idx) FILTER (cited IS NOT NULL) AS cited, arg_min(page, page_idx) FILTER (open AND question) AS asked, arg_max(page, page_idx) FILTER (open) AS last FROM (
    SELECT doc_id, page_idx, page, coalesce(page_idx < min(CASE WHEN stop THEN page_idx END) OVER (PARTITION BY doc_id), true) AS open, question, cited FROM (
      SELECT doc_id, page_idx, page, contains(upper(text), 'CERTIFICATE OF CERTIFIED SHORTHAND') OR contains(upper(text), 'CERTIFICATION OF CERTIFIED SHORTHAND') OR contains(upper(text), 'CERTIFICATE OF REPORTER')
        OR contains(upper(text), 'WORD INDEX') OR contains(upper(text), 'CONCORDANCE') OR (contains(upper(text), 'I, ') AND contains(upper(text), 'DO SOLEMNLY DECLARE UNDER PENALTY')) AS stop,
        regexp_matches(text, '(?m)^\s*\d+\s+(?:BY\s+[A-Z\.\s]+:)?\s*Q[\.\:\s]') AS question,
        CASE WHEN page_idx < 15 AND contains(upper(text), 'INDEX') THEN TRY_CAST(nullif(regexp_extract(text, '(?im)(?:EXAMINATION|DIRECT|TESTIMONY).*?(\d+)\s*$', 1), '') AS BIGINT) END AS cited FROM printed)) GROUP BY doc_id)"""))
def bounds_detect(spark, sf_dir):
    return lines.testimony_bounds(_pages(spark, sf_dir))


_METADATA = r"""first AS (
  SELECT doc_id, string_agg(text, chr(10) ORDER BY page_idx) AS t FROM printed WHERE page_idx < 10 GROUP BY doc_id
), found AS (
  SELECT doc_id,
    coalesce(nullif(trim(regexp_extract(t, '(?i)DEPOSITION\s+OF\s+([A-Z\s\.\,\-]+?)(?:\n|\r|\t|Taken|held|Tuesday|Wednesday|Monday|Thursday|Friday|Saturday|Sunday|March|April|May|June|July|August|September|October|November|December)', 1)), ''),
      nullif(trim(regexp_extract(t, '(?i)WITNESS\s*[:\-]?\s*([A-Z\s\.\,\-]+?)(?:\n|\r|\t|By\s|Page)', 1)), '')) AS w,
    nullif(trim(regexp_extract(t, '(?i)BY\s+(MR\.\s+[A-Z]+|MS\.\s+[A-Z]+)', 1)), '') AS attorney,
    nullif(trim(regexp_extract(t, '(?i)((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:st|nd|rd|th)?,\s+\d{4})', 1)), '') AS date,
    coalesce(nullif(trim(regexp_extract(t, '(?i)(?:matter\s+of|case\s+of)\s+([A-Z\s\.\,\-]+?\s+(?:vs\.?|v\.?)\s+[A-Z\s\.\,\-]+?)(?:,|\n|\r|\.|\;)', 1)), ''),
      nullif(trim(regexp_extract(t, '(?i)([A-Z\s\.\,\-]+?\s+(?:vs\.?|v\.?)\s+[A-Z\s\.\,\-]+?)(?:,|\n|\r|\.|\;)', 1)), '')) AS case_name FROM first
), about AS (
  SELECT doc_id, array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN regexp_split_to_array(w, '\s+') IF x <> ''], ' ') AS witness, attorney, date, case_name FROM found
)"""


@query(_with(GRID, PAGES, _METADATA, select="SELECT * FROM about"))
def metadata_extract(spark, sf_dir):
    return lines.document_metadata(_pages(spark, sf_dir))


@query("SELECT page_id, CASE WHEN suffix(lower(n), '.pdf') THEN n ELSE n || '.pdf' END AS filename FROM (SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}._\\- ]', '', 'g') AS n FROM pages)")
def upload_names(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", transcripts.safe_upload_name(F.col("url")).alias("filename"))


# --- chunks and cleaning ------------------------------------------------------------------------------


@query(_with(GRID, CHUNKED.format(source="grid"), select="SELECT doc_id, chunk_id, arg_min(page, global_line_id) AS start_page, arg_min(line, global_line_id) AS start_line, arg_max(page, global_line_id) AS end_page, arg_max(line, global_line_id) AS end_line, count(*) AS n_lines FROM chunked GROUP BY doc_id, chunk_id"))
def page_chunks(spark, sf_dir):
    return chunks.chunk_bounds(chunks.chunk_lines(_grid(spark, sf_dir), 2, 1))


@query(_with(GRID, CHUNKED.format(source="grid"), select="SELECT doc_id, chunk_id, global_line_id FROM chunked"))
def chunk_members(spark, sf_dir):
    return chunks.chunk_lines(_grid(spark, sf_dir), 2, 1).select("doc_id", "chunk_id", "global_line_id")


_PHRASES = ",".join(f"'{p}'" for p in T.PROCEDURAL_PHRASES)
_KINDS = f"""kinds AS (
  SELECT *, CASE WHEN trim(text) = '' THEN 'blank'
    WHEN plain IN ({_PHRASES}) OR (starts_with(plain, 'objection') AND len(regexp_extract_all(plain, '\\S+')) <= 5) OR regexp_matches(plain, '^(?:same|continuing|standing)\\s+objection') THEN 'noise'
    WHEN {" OR ".join(f"regexp_matches(text, '{p}')" for p in T.NOTE_PATTERNS)} THEN 'note' ELSE 'talk' END AS kind
  FROM (SELECT *, {_strip("regexp_replace(lower(text), '[^a-z\\s]', '', 'g')")} AS plain FROM chunked)
), cleaned AS (
  SELECT {{columns}}, CASE kind WHEN 'noise' THEN '[OBJECTION]' WHEN 'note' THEN '[PROCEDURAL]' ELSE text END AS text
  FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id, chunk_id ORDER BY global_line_id) AS before FROM kinds) WHERE NOT (kind = 'noise' AND coalesce(before, '') = 'noise')
)"""
_CLEANED = _KINDS.replace("{columns}", "doc_id, chunk_id, global_line_id")


@query(_with(GRID, NOISY, CHUNKED.format(source="noisy"), _CLEANED, select="SELECT * FROM cleaned"))
def clean_lines(spark, sf_dir):
    return chunks.clean_chunks(chunks.chunk_lines(_noisy(spark, sf_dir), 2, 1)).select("doc_id", "chunk_id", "global_line_id", "text")


@query(_with(GRID, NOISY, CHUNKED.format(source="noisy"), _CLEANED, select="SELECT b.doc_id, b.n AS tokens_before, a.n AS tokens_after, round(100.0 * (b.n - a.n) / greatest(1, b.n), 1) AS reduction_pct FROM (SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n FROM chunked GROUP BY doc_id) b JOIN (SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n FROM cleaned GROUP BY doc_id) a USING (doc_id)"))
def clean_stats(spark, sf_dir):
    chunked = chunks.chunk_lines(_noisy(spark, sf_dir), 2, 1)
    return chunks.cleaning_stats(chunked, chunks.clean_chunks(chunked))


@query(_with(GRID, select=f"SELECT doc_id, global_line_id, array_to_string({_kw('text')}, ' ') AS keywords FROM grid"))
def keywords(spark, sf_dir):
    return chunks.line_keywords(_grid(spark, sf_dir)).select("doc_id", "global_line_id", F.array_join("keywords", " ").alias("keywords"))


@query(_with(GRID, f"""k AS (SELECT doc_id, global_line_id, list_distinct({_kw("text")}) AS x, list_distinct({_kw("coalesce(lead(text) OVER (PARTITION BY doc_id ORDER BY global_line_id), '')")}) AS y FROM grid)""", select="SELECT doc_id, global_line_id, CASE WHEN least(len(x), len(y)) > 0 THEN CAST(len(list_intersect(x, y)) AS DOUBLE) / least(len(x), len(y)) ELSE 0.0 END AS overlap FROM k"))
def keyword_overlap(spark, sf_dir):
    """Of each line and the next."""
    after = F.lead("text").over(W.partitionBy("doc_id").orderBy("global_line_id"))
    rows = _grid(spark, sf_dir).withColumn("after", F.coalesce(after, F.lit("")))
    return rows.select("doc_id", "global_line_id", T.keyword_overlap(T.keywords(F.col("text")), T.keywords(F.col("after"))).alias("overlap"))


_SAID = "said AS (SELECT *, CASE WHEN max(CASE WHEN text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY global_line_id) = 1 THEN 'EXAMINATION' ELSE '' END AS speaker FROM grid)"
_CHUNKED_SAID = CHUNKED.format(source="said").replace("page, line, text\n", "page, line, text, speaker\n")
_PROMPTS = _KINDS.replace("{columns}", "doc_id, chunk_id, global_line_id, page, line, speaker") + """, bodies AS (
  SELECT doc_id, chunk_id, arg_min(page, global_line_id) AS start_page, arg_max(page, global_line_id) AS end_page,
    coalesce(string_agg(CASE WHEN trim(text) <> '' THEN format('[P{:02d}:L{:02d}] ', page, line) || CASE WHEN speaker <> '' THEN speaker || ': ' ELSE '' END || text END, chr(10) ORDER BY global_line_id), '') AS body FROM cleaned GROUP BY doc_id, chunk_id
)"""


@query(_with(GRID, PAGES, _METADATA, _SAID, _CHUNKED_SAID, _PROMPTS, select="""SELECT doc_id, chunk_id, start_page, end_page,
  concat_ws(chr(10), 'DEPOSITION CONTEXT:', CASE WHEN witness <> '' THEN '  Witness/Deponent: ' || witness END, CASE WHEN case_name <> '' THEN '  Case/Matter: ' || case_name END, CASE WHEN attorney <> '' THEN '  Examining Attorney: ' || attorney END, CASE WHEN date <> '' THEN '  Date: ' || date END)
  || chr(10) || chr(10) || 'Analyze this deposition transcript segment (Pages ' || start_page || ' to ' || end_page || '):' || chr(10) || chr(10) || body || chr(10) || chr(10) || 'Extract all chronological topic segments according to the specified JSON schema.' AS prompt
  FROM bodies LEFT JOIN about USING (doc_id)"""))
def prompt_text(spark, sf_dir):
    chunked = chunks.chunk_lines(_lines(spark, sf_dir), 2, 1)
    return chunks.prompts(chunks.clean_chunks(chunked), lines.document_metadata(_pages(spark, sf_dir)))


def _answers(spark, sf_dir):
    d = F.col("doc_id")
    bounds = chunks.chunk_bounds(chunks.chunk_lines(_grid(spark, sf_dir), 2, 1))
    full = F.format_string('[{"topic":" T%d ","start_page":"%d","start_line":2.0,"end_page":%d,"end_line":"9","summary":"s","supporting_quote":" q "},{"summary":"only"}]', d, F.col("start_page"), F.col("end_page"))
    answer = F.when(d % 3 == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).when(d % 3 == 1, full).otherwise("no json")
    return bounds.withColumn("answer", answer)


@query(_with(GRID, CHUNKED.format(source="grid"), select="""SELECT doc_id, chunk_id * 1000000 + nth AS candidate_id, CASE nth WHEN 0 THEN 'T' || doc_id ELSE 'Untitled Topic' END AS topic, sp AS start_page, CAST(CASE nth WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS start_line, ep AS end_page, CAST(CASE nth WHEN 0 THEN 9 ELSE 25 END AS BIGINT) AS end_line,
  CASE nth WHEN 0 THEN 's' ELSE 'only' END AS summary, CASE nth WHEN 0 THEN 'q' ELSE '' END AS supporting_quote FROM (SELECT doc_id, chunk_id, min(page) AS sp, max(page) AS ep FROM chunked GROUP BY doc_id, chunk_id) CROSS JOIN (SELECT unnest([0, 1]) AS nth) WHERE doc_id % 3 < 2"""))
def llm_decode(spark, sf_dir):
    return chunks.decode_candidates(_answers(spark, sf_dir)).select("doc_id", "candidate_id", "topic", "start_page", "start_line", "end_page", "end_line", "summary", "supporting_quote")


# --- look-ups, ranges and search --------------------------------------------------------------------


@query(_with(GRID, TOPICS, select="SELECT t.doc_id, t.candidate_id, s.global_line_id AS start_gid, s.text AS start_text, e.global_line_id AS end_gid, e.text AS end_text FROM topics t LEFT JOIN grid s ON s.doc_id = t.doc_id AND s.page = t.start_page AND s.line = t.start_line LEFT JOIN grid e ON e.doc_id = t.doc_id AND e.page = t.end_page AND e.line = t.end_line"))
def coord_lookup(spark, sf_dir):
    index = validate.line_index(_grid(spark, sf_dir))
    both = validate.look_up(validate.look_up(_topics(spark, sf_dir), index, "start"), index, "end")
    return both.select("doc_id", "candidate_id", "start_gid", "start_text", "end_gid", "end_text")


_INSIDE = "g.doc_id = t.doc_id AND (g.page > t.start_page OR (g.page = t.start_page AND g.line >= t.start_line)) AND (g.page < t.end_page OR (g.page = t.end_page AND g.line <= t.end_line))"


@query(_with(GRID, TOPICS, select=f"SELECT t.doc_id, t.candidate_id, count(*) AS n_lines, coalesce(string_agg(CASE WHEN trim(g.text) <> '' THEN g.text END, ' ' ORDER BY g.global_line_id), '') AS text FROM topics t JOIN grid g ON {_INSIDE} GROUP BY t.doc_id, t.candidate_id"))
def range_text(spark, sf_dir):
    return validate.range_text(_topics(spark, sf_dir), _grid(spark, sf_dir))


@query(_with(GRID, select="SELECT doc_id, global_line_id FROM grid WHERE (page > 1 OR line >= 20) AND (page < 3 OR (page = 3 AND line <= 4))"))
def coord_range(spark, sf_dir):
    return lines.in_range(_grid(spark, sf_dir), F.lit(1), F.lit(20), F.lit(3), F.lit(4)).select("doc_id", "global_line_id")


@query(_with(GRID, TOPICS, select=f"SELECT t.doc_id, t.candidate_id, count(*) AS n_lines, min(g.global_line_id) AS first_gid, max(g.global_line_id) AS last_gid FROM topics t JOIN grid g ON {_INSIDE} GROUP BY t.doc_id, t.candidate_id"))
def range_highlight(spark, sf_dir):
    return evaluate.highlighted(_topics(spark, sf_dir), _grid(spark, sf_dir))


@query(_with(GRID, TOPICS, select="SELECT doc_id, candidate_id, topic FROM topics WHERE contains(lower(topic), 'tion') OR contains(lower(summary), 'tion') OR contains(lower(supporting_quote), 'tion')"))
def topic_search(spark, sf_dir):
    return evaluate.search(_topics(spark, sf_dir), " Tion ").select("doc_id", "candidate_id", "topic")


@query(_with(GRID, TOPICS, select="SELECT doc_id, candidate_id, topic FROM topics WHERE contains(lower(topic), 'ation') OR contains(lower(summary), 'ation') OR contains(lower(supporting_quote), 'ation')"))
def topic_search_indexed(spark, sf_dir):
    topics = _kept(_topics(spark, sf_dir), "topics")
    index = evaluate.search_index(Scratch(spark, "query"), topics)
    return evaluate.search_indexed(topics, index, " Ation ").select("doc_id", "candidate_id", "topic")


@query(_with("d AS (SELECT doc_id, " + _norm("text") + " AS n FROM documents)", "b AS (SELECT item_id, " + _norm("text") + " AS q FROM benchmark)", select="SELECT doc_id, item_id FROM d JOIN b ON contains(n, q) WHERE length(q) >= 5"))
def quoted_items(spark, sf_dir):
    """Which documents hold which benchmark item, word for word."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", T.normalized(F.col("text")).alias("n"))
    items = _table(spark, sf_dir, "benchmark").select("item_id", T.normalized(F.col("text")).alias("q")).where(F.length("q") >= validate.SHORTEST)
    return validate.containing(docs, items)


# --- validation -----------------------------------------------------------------------------------------

_LOCATED = f"""lim AS (SELECT doc_id, min(page) AS min_page, max(page) AS max_page FROM grid GROUP BY doc_id
), fixed AS (
  SELECT doc_id, candidate_id, topic, supporting_quote, inv AS inverted, CASE WHEN inv THEN end_page ELSE start_page END AS sp, CASE WHEN inv THEN end_line ELSE start_line END AS sl,
         CASE WHEN inv THEN start_page ELSE end_page END AS ep, CASE WHEN inv THEN start_line ELSE end_line END AS el
  FROM (SELECT *, start_page > end_page OR (start_page = end_page AND start_line > end_line) AS inv FROM topics)
), want AS (
  SELECT doc_id, candidate_id, q, greatest(1, least(10, len(regexp_extract_all(q, '\\S+')) // 5 + 1)) AS size, greatest(min_page, sp - 2) AS lo, least(max_page, ep + 2) AS hi
  FROM (SELECT f.*, {_norm("supporting_quote")} AS q, min_page, max_page FROM fixed f JOIN lim USING (doc_id)) WHERE length(q) >= 5
), said AS (
  SELECT doc_id, page, line, global_line_id, list({{'page': page, 'line': line, 'gid': global_line_id, 'text': text}}) OVER (PARTITION BY doc_id ORDER BY global_line_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead
  FROM grid WHERE trim(text) <> ''
), seen AS (
  SELECT *, {_norm("array_to_string([x.text FOR x IN w], ' ')")} AS win FROM (
    SELECT doc_id, candidate_id, q, [x FOR x IN ahead[1:size] IF x.page BETWEEN lo AND hi] AS w FROM want JOIN said USING (doc_id) WHERE page BETWEEN lo AND hi)
), scored AS (
  SELECT doc_id, candidate_id, w[1] AS a, w[-1] AS b, CASE WHEN contains(win, q) THEN 1.0 WHEN contains(q, win) AND length(win) >= 15 THEN 0.9 ELSE 0.0 END AS score FROM seen WHERE length(win) >= 5
), best AS (
  SELECT doc_id, candidate_id, CAST(score AS DOUBLE) AS score, a, b FROM scored WHERE score >= 0.65 QUALIFY row_number() OVER (PARTITION BY doc_id, candidate_id ORDER BY score DESC, a.gid) = 1
)"""


@query(_with(GRID, TOPICS, _LOCATED, select="SELECT doc_id, candidate_id, score AS quote_score, a.gid AS q_start_gid, b.gid AS q_end_gid FROM best"))
def quote_exact(spark, sf_dir):
    grid = _kept(_grid(spark, sf_dir), "lines")
    t = _topics(spark, sf_dir, grid)
    late = F.struct("start_page", "start_line") > F.struct(F.col("end_page").alias("start_page"), F.col("end_line").alias("start_line"))
    t = t.select("doc_id", "candidate_id", "supporting_quote", F.when(late, F.col("end_page")).otherwise(F.col("start_page")).alias("start_page"), F.when(late, F.col("start_page")).otherwise(F.col("end_page")).alias("end_page"))
    return validate.locate_quotes(t, grid, fuzzy=False).select("doc_id", "candidate_id", "quote_score", "q_start_gid", "q_end_gid")


_VERDICT = f"""looked AS (
  SELECT f.*, coalesce(b.score, 0.0) AS score, b.a, b.b, s.global_line_id AS sg, s.text AS st, e.global_line_id AS eg, e.text AS et
  FROM fixed f LEFT JOIN best b USING (doc_id, candidate_id) LEFT JOIN grid s ON s.doc_id = f.doc_id AND s.page = f.sp AND s.line = f.sl LEFT JOIN grid e ON e.doc_id = f.doc_id AND e.page = f.ep AND e.line = f.el
), snapped AS (
  SELECT doc_id, candidate_id, topic, supporting_quote, inverted, score, CASE WHEN ms THEN a.page ELSE sp END AS start_page, CASE WHEN ms THEN a.line ELSE sl END AS start_line, CASE WHEN me THEN b.page ELSE ep END AS end_page,
         CASE WHEN me THEN b.line ELSE el END AS end_line, CASE WHEN ms THEN a.gid ELSE sg END AS sg, CASE WHEN me THEN b.gid ELSE eg END AS eg
  FROM (SELECT *, score >= 0.7 AND (sg IS NULL OR trim(st) = '' OR a.page <> sp OR abs(a.line - sl) > 3) AS ms, score >= 0.7 AND (eg IS NULL OR trim(et) = '') AS me FROM looked)
), ranges AS (
  SELECT t.doc_id, t.candidate_id, string_agg(CASE WHEN trim(g.text) <> '' THEN g.text END, ' ' ORDER BY g.global_line_id) AS said FROM snapped t JOIN grid g ON {_INSIDE} GROUP BY t.doc_id, t.candidate_id
), labelled AS (
  SELECT t.*, r.doc_id IS NOT NULL AND trim(topic) <> '' AS ok, list_distinct({_kw("topic")}) AS x, list_distinct({_kw("coalesce(said, '') || ' ' || supporting_quote")}) AS y FROM snapped t LEFT JOIN ranges r USING (doc_id, candidate_id)
), judged AS (
  SELECT *, CASE WHEN ok AND least(len(x), len(y)) > 0 THEN CAST(len(list_intersect(x, y)) AS DOUBLE) / least(len(x), len(y)) ELSE 0.0 END AS semantic FROM labelled
), verdicts AS (
  SELECT *, sg IS NOT NULL AND eg IS NOT NULL AND score >= 0.7 AND semantic >= 0.15 AND NOT inverted AS verified FROM judged
)"""


def _misquoted(t: DataFrame) -> DataFrame:
    """Quotes that lost the eighth letter of each long word, so that they are found by similarity."""
    return t.withColumn("supporting_quote", F.regexp_replace("supporting_quote", r"(\w{7})\w", "$1"))


def _validated(spark, sf_dir, fuzzy: bool) -> DataFrame:
    grid = _kept(_grid(spark, sf_dir), "lines")
    t = _kept(_topics(spark, sf_dir, grid), "topics")
    return validate.validate(_misquoted(t) if fuzzy else t, layout.shared(Scratch(spark, "query"), grid), fuzzy)


@query(_with(GRID, TOPICS, _LOCATED, _VERDICT, select="SELECT doc_id, candidate_id, start_page, start_line, end_page, end_line, sg AS start_global_id, eg AS end_global_id, score AS quote_score, semantic AS semantic_score, inverted, verified, CASE WHEN verified THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, NOT verified AS needs_human_review FROM verdicts"))
def verdict_exact(spark, sf_dir):
    out = _validated(spark, sf_dir, fuzzy=False)
    return out.select("doc_id", "candidate_id", "start_page", "start_line", "end_page", "end_line", "start_global_id", "end_global_id", "quote_score", "semantic_score", "inverted", "verified", "confidence", "needs_human_review")


@query(_with(GRID, TOPICS, _LOCATED, _VERDICT, select="SELECT doc_id, candidate_id FROM verdicts WHERE verified"))
def fully_verified(spark, sf_dir):
    out = _validated(spark, sf_dir, fuzzy=False)
    return out.where(evaluate.fully_verified()).select("doc_id", "candidate_id")


@query()
def verdict_fuzzy(spark, sf_dir):
    """Quotes with lost letters are found by similarity."""
    return _validated(spark, sf_dir, fuzzy=True).select("doc_id", "candidate_id", "start_page", "start_line", "end_page", "end_line", F.round("quote_score", 9).alias("quote_score"), "verified")


@query()
def quote_fuzzy(spark, sf_dir):
    grid = _kept(_grid(spark, sf_dir), "lines")
    t = _misquoted(_topics(spark, sf_dir, grid))
    return validate.locate_quotes(t, layout.shared(Scratch(spark, "query"), grid)).select("doc_id", "candidate_id", F.round("quote_score", 9).alias("quote_score"), "q_start_gid", "q_end_gid")


# --- merging --------------------------------------------------------------------------------------------

_MERGED = """o AS (
  SELECT doc_id, candidate_id, topic, start_page AS sp, start_line AS sl, end_page AS ep, end_line AS el, summary, confidence, row_number() OVER (PARTITION BY doc_id ORDER BY start_page, start_line, end_page, end_line, candidate_id) AS rn FROM topics
), f AS (
  SELECT doc_id, rn, candidate_id, topic, sp, sl, ep, el, summary, confidence FROM o WHERE rn = 1
  UNION ALL
  SELECT doc_id, rn, CASE act WHEN 'k' THEN c2 ELSE candidate_id END, CASE act WHEN 'k' THEN topic2 ELSE topic END, CASE act WHEN 'k' THEN sp2 ELSE sp END, CASE act WHEN 'k' THEN sl2 ELSE sl END,
    CASE act WHEN 'k' THEN ep2 ELSE greatest(ep, ep2) END,
    CASE act WHEN 'k' THEN el2 WHEN 'm' THEN CASE WHEN ep2 > ep THEN el2 ELSE greatest(el, el2) END ELSE CASE WHEN ep2 >= ep THEN greatest(el, el2) ELSE el2 END END,
    CASE act WHEN 'k' THEN summary2 WHEN 'm' THEN CASE WHEN summary2 <> '' AND NOT contains(summary, summary2) THEN trim(summary || ' ' || summary2) ELSE summary END ELSE summary END,
    CASE act WHEN 'k' THEN conf2 WHEN 'm' THEN least(1.0::DOUBLE, greatest(confidence, conf2) + 0.05::DOUBLE) ELSE confidence END
  FROM (SELECT *, CASE WHEN near AND (contains(t1, t2) OR contains(t2, t1) OR (least(e1 - s1, e2 - s2) + 1 > 0 AND 2 * greatest(0, least(e1, e2) - greatest(s1, s2) + 1) > least(e1 - s1, e2 - s2) + 1)) THEN 'm'
                        WHEN span <= 4 AND (contains(upper(topic2), 'OBJECTION') OR contains(upper(topic2), 'BREAK')) THEN 'a' ELSE 'k' END AS act
    FROM (SELECT f.*, o.rn AS rn2, o.candidate_id AS c2, o.topic AS topic2, o.sp AS sp2, o.sl AS sl2, o.ep AS ep2, o.el AS el2, o.summary AS summary2, o.confidence AS conf2, lower(trim(f.topic)) AS t1, lower(trim(o.topic)) AS t2,
        (f.sp - 1) * 25 + f.sl AS s1, (f.ep - 1) * 25 + f.el AS e1, (o.sp - 1) * 25 + o.sl AS s2, (o.ep - 1) * 25 + o.el AS e2,
        NOT (f.sp > o.ep OR (f.sp = o.ep AND f.sl > o.el)) AND (o.sp < f.ep OR (o.sp = f.ep AND o.sl <= f.el + 3) OR (o.sp = f.ep + 1 AND f.el >= 23 AND o.sl <= 3)) AS near,
        CASE WHEN o.sp = o.ep THEN greatest(1, o.el - o.sl + 1) ELSE 26 - o.sl + 25 * greatest(0, o.ep - o.sp - 1) + o.el END AS span
      FROM f JOIN o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1) AS j0(doc_id, rn0, candidate_id, topic, sp, sl, ep, el, summary, confidence, rn, c2, topic2, sp2, sl2, ep2, el2, summary2, conf2, t1, t2, s1, e1, s2, e2, near, span))
), merged AS (
  SELECT doc_id, candidate_id, topic, sp AS start_page, sl AS start_line, ep AS end_page, el AS end_line, summary, round(confidence, 6) AS confidence FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, candidate_id ORDER BY rn DESC) = 1
)"""
_MERGED_COLUMNS = ("doc_id", "candidate_id", "topic", "start_page", "start_line", "end_page", "end_line", "summary")


@query(_with(GRID, TOPICS, _MERGED, select="SELECT * FROM merged", recursive=True))
def merge_exact(spark, sf_dir):
    return merge.merge_topics(_topics(spark, sf_dir), threshold=1.1).select(*_MERGED_COLUMNS, F.round("confidence", 6).alias("confidence"))


@query()
def merge_fuzzy(spark, sf_dir):
    return merge.merge_topics(_topics(spark, sf_dir)).select(*_MERGED_COLUMNS, F.round("confidence", 6).alias("confidence"))


@query(_with(GRID, TOPICS, select="""SELECT doc_id, a, b, CASE WHEN least(e1 - s1, e2 - s2) + 1 > 0 THEN CAST(greatest(0, least(e1, e2) - greatest(s1, s2) + 1) AS DOUBLE) / (least(e1 - s1, e2 - s2) + 1) ELSE 0.0 END AS overlap,
  CASE WHEN bsp = bep THEN greatest(1, bel - bsl + 1) ELSE 26 - bsl + 25 * greatest(0, bep - bsp - 1) + bel END AS span,
  NOT (asp > bep OR (asp = bep AND asl > bel)) AND (bsp < aep OR (bsp = aep AND bsl <= ael + 3) OR (bsp = aep + 1 AND ael >= 23 AND bsl <= 3)) AS touches
  FROM (SELECT x.doc_id, x.candidate_id AS a, y.candidate_id AS b, x.start_page AS asp, x.start_line AS asl, x.end_page AS aep, x.end_line AS ael, y.start_page AS bsp, y.start_line AS bsl, y.end_page AS bep, y.end_line AS bel,
    (x.start_page - 1) * 25 + x.start_line AS s1, (x.end_page - 1) * 25 + x.end_line AS e1, (y.start_page - 1) * 25 + y.start_line AS s2, (y.end_page - 1) * 25 + y.end_line AS e2
    FROM topics x JOIN topics y ON x.doc_id = y.doc_id AND y.candidate_id = x.candidate_id + 1)"""))
def overlap_pairs(spark, sf_dir):
    t = _topics(spark, sf_dir).select("doc_id", "candidate_id", "start_page", "start_line", "end_page", "end_line")
    x = t.toDF("doc_id", "a", "asp", "asl", "aep", "ael")
    y = t.withColumn("a", F.col("candidate_id") - 1).toDF("doc_id", "b", "bsp", "bsl", "bep", "bel", "a")
    c = F.col
    both = x.join(y, ["doc_id", "a"])
    return both.select(
        "doc_id", "a", "b", T.overlap_ratio(T.linear(c("asp"), c("asl")), T.linear(c("aep"), c("ael")), T.linear(c("bsp"), c("bsl")), T.linear(c("bep"), c("bel"))).alias("overlap"),
        T.line_span(c("bsp"), c("bsl"), c("bep"), c("bel")).alias("span"), T.touches(*map(c, ("asp", "asl", "aep", "ael", "bsp", "bsl", "bep", "bel"))).alias("touches"),
    )


# --- audit ------------------------------------------------------------------------------------------------

#: Topics as they are, but of every third document's ones each ends where it begins.
_SPARSE = "thin AS (SELECT doc_id, candidate_id, start_page, start_line, CASE WHEN doc_id % 3 = 0 THEN start_page ELSE end_page END AS end_page, CASE WHEN doc_id % 3 = 0 THEN start_line ELSE end_line END AS end_line FROM topics)"


def _thin(spark, sf_dir):
    short = F.col("doc_id") % 3 == 0
    return _topics(spark, sf_dir).withColumns({f"end_{c}": F.when(short, F.col(f"start_{c}")).otherwise(F.col(f"end_{c}")) for c in ("page", "line")})


_MARKED = f"marked AS (SELECT g.*, EXISTS (SELECT 1 FROM thin t WHERE {_INSIDE}) AS covered FROM grid g)"
_GAPS = """islands AS (
  SELECT *, sum(CASE WHEN covered THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY global_line_id) AS island FROM marked
), gap_rows AS (
  SELECT doc_id, island, arg_min(page, global_line_id) AS start_page, arg_min(line, global_line_id) AS start_line, arg_max(page, global_line_id) AS end_page, arg_max(line, global_line_id) AS end_line, count(*) AS line_count, min(global_line_id) AS begins,
    coalesce(string_agg(CASE WHEN trim(text) <> '' THEN text END, ' ' ORDER BY global_line_id), '') AS all_text FROM islands WHERE NOT covered GROUP BY doc_id, island
), found AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY begins) AS gap, start_page, start_line, end_page, end_line, line_count, CASE WHEN all_text = '' THEN '(Blank lines / formatting)' ELSE substring(all_text, 1, 120) END AS sample_text,
    trim(all_text) = '' OR contains(upper(all_text), 'RECESS') OR contains(upper(all_text), 'OFF THE RECORD') OR contains(upper(all_text), 'EXAMINATION CONTINUED') OR contains(upper(all_text), 'WHEREUPON') AS is_administrative FROM gap_rows
)"""
_COVERAGE = "cover AS (SELECT doc_id, count(*) AS total_lines, count(DISTINCT CASE WHEN covered THEN {'p': page, 'l': line} END) AS covered_lines FROM marked GROUP BY doc_id)"


@query(_with(GRID, TOPICS, _SPARSE, _MARKED, _COVERAGE, select="SELECT *, round(100.0 * covered_lines / greatest(1, total_lines), 2) AS coverage_percentage FROM cover"))
def coverage(spark, sf_dir):
    """All lines; every third document's topics are cut to their first line, so that there are gaps to find (also in the next two)."""
    return audit.coverage(audit.mark_covered(_grid(spark, sf_dir), _thin(spark, sf_dir)))


@query(_with(GRID, TOPICS, _SPARSE, _MARKED, _GAPS, select="SELECT * FROM found"))
def gaps(spark, sf_dir):
    return audit.gaps(audit.mark_covered(_grid(spark, sf_dir), _thin(spark, sf_dir)))


@query(_with(GRID, TOPICS, _SPARSE, _MARKED, _GAPS, _COVERAGE, select="SELECT c.doc_id, total_lines, covered_lines, round(100.0 * covered_lines / greatest(1, total_lines), 2) AS coverage_percentage, coalesce(n, 0) AS n_gaps, coalesce(a, 0) AS n_administrative, coalesce(x, false) AS has_critical_omissions FROM cover c LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN is_administrative THEN 1 ELSE 0 END) AS BIGINT) AS a, bool_or(NOT is_administrative AND line_count > 5) AS x FROM found GROUP BY doc_id) USING (doc_id)"))
def omission_report(spark, sf_dir):
    return audit.omission_report(_grid(spark, sf_dir), _thin(spark, sf_dir)).drop("uncovered_segments")


# --- evaluation -------------------------------------------------------------------------------------------

_NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_page, start_line, end_page, end_line, candidate_id) AS num, count(*) OVER (PARTITION BY doc_id) AS n FROM topics)"
_SAMPLED = "sampled AS (SELECT *, (num - 1) // step + 1 AS pick FROM (SELECT *, least(20, n) AS k, greatest(1, n // least(20, n)) AS step FROM numbered) WHERE (num - 1) % step = 0 AND num - 1 < k * step)"
_MATRIX = """matrix AS (
  SELECT t.doc_id, t.pick AS num, topic, 'P' || start_page || ':L' || start_line || ' - P' || end_page || ':L' || end_line AS range, CAST(CASE WHEN s.doc_id IS NOT NULL AND e.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END AS DOUBLE) AS location, CAST(1.0 AS DOUBLE) AS relevance,
    CAST(CASE WHEN start_line <= 25 AND end_line <= 25 THEN 0.95 ELSE 0.8 END AS DOUBLE) AS boundary, CASE WHEN supporting_quote <> '' THEN substring(supporting_quote, 1, 80) || '...' ELSE '(Verified)' END AS quote
  FROM sampled t LEFT JOIN grid s ON s.doc_id = t.doc_id AND s.page = t.start_page AND s.line = t.start_line LEFT JOIN grid e ON e.doc_id = t.doc_id AND e.page = t.end_page AND e.line = t.end_line
)"""


@query(_with(GRID, TOPICS, _NUMBERED, _SAMPLED, _MATRIX, select="SELECT * FROM matrix"))
def sample_audit(spark, sf_dir):
    return evaluate.audit_matrix(_topics(spark, sf_dir), validate.line_index(_grid(spark, sf_dir)))


@query(_with(GRID, TOPICS, _NUMBERED, _SAMPLED, _MATRIX, select="SELECT doc_id, count(*) AS sampled, round(avg(location) * 100, 1) AS avg_location, round(avg(relevance) * 100, 1) AS avg_relevance, round(avg(boundary) * 100, 1) AS avg_boundary FROM matrix GROUP BY doc_id"))
def quality_means(spark, sf_dir):
    return evaluate.quality_means(evaluate.audit_matrix(_topics(spark, sf_dir), validate.line_index(_grid(spark, sf_dir))))


@query(_with(GRID, TOPICS, select="SELECT doc_id, count(*) AS n_topics, CAST(0 AS BIGINT) AS n_verified, round(100.0 * (1 - CAST(count(DISTINCT {'p': start_page, 'l': start_line // 5}) AS DOUBLE) / count(*)), 1) AS redundancy_pct FROM topics GROUP BY doc_id"))
def redundancy(spark, sf_dir):
    """All topics; their start lines are folded by five, so that some begin at one place."""
    return evaluate.redundancy(_topics(spark, sf_dir).withColumn("start_line", F.floor(F.col("start_line") / 5)))


def _runs(spark, sf_dir):
    """Three runs: as it is, without every fourth topic, and with other titles for every third."""
    t, k = _kept(_topics(spark, sf_dir).select("doc_id", "candidate_id", "topic"), "topics"), F.col("candidate_id")
    three = (t.withColumn("run_id", F.lit(1)), t.where(k % 4 != 3).withColumn("run_id", F.lit(2)), t.withColumn("run_id", F.lit(3)).withColumn("topic", F.when(k % 3 == 2, F.concat("topic", F.lit(" again"))).otherwise(F.col("topic"))))
    return three[0].unionByName(three[1]).unionByName(three[2])


@query(_with(GRID, TOPICS, """runs AS (
  SELECT doc_id, candidate_id, 1 AS run_id, lower(trim(topic)) AS label FROM topics UNION ALL SELECT doc_id, candidate_id, 2, lower(trim(topic)) FROM topics WHERE candidate_id % 4 <> 3
  UNION ALL SELECT doc_id, candidate_id, 3, lower(trim(CASE WHEN candidate_id % 3 = 2 THEN topic || ' again' ELSE topic END)) FROM topics
), pairs AS (
  SELECT a.doc_id, a.run_id AS x, r.run_id AS y, avg(CASE WHEN EXISTS (SELECT 1 FROM runs b WHERE b.doc_id = a.doc_id AND b.run_id = r.run_id AND b.label = a.label) THEN 1.0 ELSE 0.0 END) AS s
  FROM runs a JOIN (SELECT DISTINCT doc_id, run_id FROM runs) r ON r.doc_id = a.doc_id AND r.run_id > a.run_id GROUP BY a.doc_id, a.run_id, r.run_id
)""", select="SELECT doc_id, c.runs, c.count_variance, m.mean_similarity FROM (SELECT doc_id, count(*) AS runs, max(n) - min(n) AS count_variance FROM (SELECT doc_id, run_id, count(*) AS n FROM runs GROUP BY doc_id, run_id) GROUP BY doc_id) c LEFT JOIN (SELECT doc_id, round(avg(s), 6) AS mean_similarity FROM pairs GROUP BY doc_id) m USING (doc_id)"))
def stability_exact(spark, sf_dir):
    return evaluate.run_stability(_runs(spark, sf_dir), threshold=1.1)


@query()
def run_stability(spark, sf_dir):
    return evaluate.run_stability(_runs(spark, sf_dir))


@query(_with(GRID, TOPICS, CHUNKED.format(source="grid"), select="SELECT t.doc_id, c.chunk_id, t.candidate_id FROM topics t JOIN (SELECT doc_id, chunk_id, min(page) AS lo, max(page) AS hi FROM chunked GROUP BY doc_id, chunk_id) c ON c.doc_id = t.doc_id AND t.start_page >= c.lo AND t.end_page <= c.hi + 1"))
def chunk_stand_ins(spark, sf_dir):
    bounds = chunks.chunk_bounds(chunks.chunk_lines(_grid(spark, sf_dir), 2, 1))
    return evaluate.within_chunks(_topics(spark, sf_dir), bounds)


# --- results ------------------------------------------------------------------------------------------------

_ESCAPED = "replace(replace({0}, chr(10), ' '), '|', '\\|')"


@query(_with(GRID, TOPICS, _NUMBERED, select=f"""SELECT doc_id, num, '| ' || num || ' | **' || topic || '** | Page ' || start_page || ', Line ' || start_line || ' | Page ' || end_page || ', Line ' || end_line || ' | ' || {_ESCAPED.format("summary")} || ' | '
  || CASE WHEN supporting_quote <> '' THEN '*"' || substring({_ESCAPED.format("supporting_quote")}, 1, 100) || '..."*' ELSE '*(No quote)*' END || ' | ⚠️ |' AS row FROM numbered"""))
def export_markdown(spark, sf_dir):
    return export.markdown_rows(_topics(spark, sf_dir))


_HTML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(_with(GRID, TOPICS, _NUMBERED, select=f"""SELECT doc_id, num, '<tr><td>' || num || '</td><td>' || {_HTML.format("topic")} || '</td><td>Page ' || start_page || ', Line ' || start_line || '</td><td>Page ' || end_page || ', Line ' || end_line || '</td><td>' || {_HTML.format("summary")}
  || '</td><td>&ldquo;' || {_HTML.format("supporting_quote")} || '&rdquo;</td><td><span class="badge badge-unverified">Review (85%)</span></td></tr>' AS row FROM numbered"""))
def export_html(spark, sf_dir):
    return export.html_rows(_topics(spark, sf_dir))


@query(_with(GRID, TOPICS, _NUMBERED, select="""SELECT doc_id, num, to_json({'topic': topic, 'start_page': start_page, 'start_line': start_line, 'end_page': end_page, 'end_line': end_line, 'start_global_id': CAST(NULL AS BIGINT), 'end_global_id': CAST(NULL AS BIGINT), 'summary': summary, 'supporting_quote': supporting_quote, 'confidence': confidence, 'verified': false, 'needs_human_review': true})::VARCHAR AS json FROM numbered"""))
def export_json(spark, sf_dir):
    return export.json_rows(_topics(spark, sf_dir))


_VIEWER = """bundles AS (
  SELECT doc_id, total_lines, lo, hi, '"title":"Deposition of unknown","witness":"","date":"","caseName":"","topics":' || coalesce(t.topics, '[]') || ',"lines":' || l.lines || '}' AS rest FROM (
    SELECT doc_id, count(*) AS total_lines, min(page) AS lo, max(page) AS hi, to_json(list({'global_id': global_line_id, 'page': page, 'line': line, 'speaker': speaker, 'text': text, 'timestamp': CAST(NULL AS VARCHAR)} ORDER BY global_line_id))::VARCHAR AS lines FROM said GROUP BY doc_id) l
  LEFT JOIN (SELECT doc_id, to_json(list({'topic': topic, 'start_page': start_page, 'start_line': start_line, 'end_page': end_page, 'end_line': end_line, 'start_global_id': CAST(NULL AS BIGINT), 'end_global_id': CAST(NULL AS BIGINT), 'summary': summary, 'supporting_quote': supporting_quote, 'confidence': confidence, 'verified': false, 'needs_human_review': true} ORDER BY num))::VARCHAR AS topics FROM numbered GROUP BY doc_id) t USING (doc_id)
)"""


def _bundled(spark, sf_dir):
    canonical = _kept(_lines(spark, sf_dir), "lines")
    t = _topics(spark, sf_dir, canonical)
    return canonical, export.topic_index(t, canonical, audit.omission_report(canonical, t))


@query(_with(GRID, TOPICS, _NUMBERED, _SAID, _VIEWER, select="SELECT doc_id, '{' || rest AS bundle FROM bundles"))
def viewer_bundle(spark, sf_dir):
    canonical, index = _bundled(spark, sf_dir)
    return export.viewer_bundle(index, canonical)


@query(_with(GRID, TOPICS, _NUMBERED, _SAID, _VIEWER, select="""SELECT doc_id, '{"success":true,"filename":"' || doc_id || '.pdf","pageRange":"' || lo || '-' || hi || '","totalLines":' || total_lines || ',' || rest AS response FROM bundles"""))
def api_response(spark, sf_dir):
    canonical, index = _bundled(spark, sf_dir)
    return export.api_response(index, canonical, F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")))


@query()
def index_documents(spark, sf_dir):
    """The whole plan on the documents: the report of each."""
    return indexing.index_lines(_lines(spark, sf_dir), pages_per_chunk=12, overlap=2).report.drop("uncovered_segments")


def _extractor(prompt: str) -> str:
    """A stand-in for a service: one topic of the first line that has a tag."""
    for row in prompt.split("\n"):
        if row.startswith("[P"):
            page, line, text = int(row[2 : row.index(":")]), int(row[row.index(":L") + 2 : row.index("]")]), row.split(": ", 1)[-1]
            return json.dumps([{"topic": text[:40], "start_page": page, "start_line": line, "end_page": page, "end_line": line, "summary": "", "supporting_quote": text}])
    return "[]"


@query()
def index_extracted(spark, sf_dir):
    """Parse, index and audit in one call, with an extractor: the report of each document."""
    return indexing.index_pages(_pages(spark, sf_dir), _extractor).report.drop("uncovered_segments")


#: Pages between the bounds, before the first certificate, dense and with the last of two blocks; the first word names a speaker or is text.
_PAGE_LINES = r"""bound AS (
  SELECT doc_id, coalesce(cited, asked, 7) AS lo, coalesce(CASE WHEN cited IS NOT NULL OR asked IS NOT NULL THEN last END, 88) AS hi FROM (
    SELECT doc_id, arg_min(cited, page_idx) FILTER (cited IS NOT NULL) AS cited, arg_min(page, page_idx) FILTER (open AND question) AS asked, arg_max(page, page_idx) FILTER (open) AS last FROM (
      SELECT doc_id, page_idx, page, coalesce(page_idx < min(CASE WHEN stop THEN page_idx END) OVER (PARTITION BY doc_id), true) AS open, question, cited FROM (
        SELECT doc_id, page_idx, page, contains(upper(text), 'CERTIFICATE OF CERTIFIED SHORTHAND') OR contains(upper(text), 'CERTIFICATION OF CERTIFIED SHORTHAND') OR contains(upper(text), 'CERTIFICATE OF REPORTER')
          OR contains(upper(text), 'WORD INDEX') OR contains(upper(text), 'CONCORDANCE') OR (contains(upper(text), 'I, ') AND contains(upper(text), 'DO SOLEMNLY DECLARE UNDER PENALTY')) AS stop,
          regexp_matches(text, '(?m)^\s*\d+\s+(?:BY\s+[A-Z\.\s]+:)?\s*Q[\.\:\s]') AS question,
          CASE WHEN page_idx < 15 AND contains(upper(text), 'INDEX') THEN TRY_CAST(nullif(regexp_extract(text, '(?im)(?:EXAMINATION|DIRECT|TESTIMONY).*?(\d+)\s*$', 1), '') AS BIGINT) END AS cited FROM printed)) GROUP BY doc_id)
), scanned AS (
  SELECT doc_id, page_idx, page FROM (
    SELECT p.*, lo, hi, min(CASE WHEN contains(upper(text), 'CERTIFICATE OF CERTIFIED SHORTHAND') OR contains(upper(text), 'CERTIFICATION OF CERTIFIED SHORTHAND') THEN page_idx END) OVER (PARTITION BY doc_id) AS cert
    FROM printed p JOIN bound USING (doc_id) WHERE page_idx < hi + 5) WHERE (cert IS NULL OR page_idx < cert) AND page BETWEEN lo AND hi
), dense AS (
  SELECT s.doc_id, s.page_idx, s.page, l.line, CASE WHEN l.line = 3 THEN 'last one wins' ELSE coalesce(regexp_replace(g.text, '^\s+|\s+$', '', 'g'), '') END AS content
  FROM scanned s CROSS JOIN (SELECT CAST(unnest(generate_series(1, 25)) AS BIGINT) AS line) l LEFT JOIN grid g ON g.doc_id = s.doc_id AND g.page = s.page_idx + 1 AND g.line = l.line
), numbers AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, line) AS gid, nullif(regexp_extract(content, '(\d{2}:\d{2})\s*$', 1), '') AS stamp,
    regexp_replace(regexp_replace(content, '(\d{2}:\d{2})\s*$', ''), '^\s+|\s+$', '', 'g') AS p FROM dense
)"""


@query(_with(GRID, PAGES, _PAGE_LINES.replace("), scanned AS (", "), capped AS (SELECT doc_id, lo, least(hi, lo + 2) AS hi FROM bound\n), scanned AS (").replace("JOIN bound USING", "JOIN capped USING"), select="SELECT doc_id, page, count(*) AS n_lines, count(CASE WHEN content <> '' THEN 1 END) AS n_filled FROM dense GROUP BY doc_id, page"))
def page_cap(spark, sf_dir):
    """Three pages of each document at most, from where its testimony begins."""
    rows = indexing.lines_of_pages(_kept(_pages(spark, sf_dir), "pages"), max_pages=3)
    return rows.groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"), F.count_if(F.col("raw_text") != "").alias("n_filled"))



@query(_with(GRID, PAGES, _METADATA, _PAGE_LINES, rf"""tagged AS (
  SELECT n.doc_id, gid, page, line, stamp,
    CASE WHEN regexp_matches(p, '{_SPEAKER}') THEN upper(regexp_extract(p, '{_SPEAKER}', 1)) WHEN regexp_matches(p, '{_LETTER}') THEN
      CASE upper(regexp_extract(p, '{_LETTER}', 1)) WHEN 'Q' THEN 'QUESTION' || coalesce(' (' || upper(trim(regexp_replace(attorney, '^(?i)(?:MR\.|MS\.)\s*', ''))) || ')', '') ELSE 'ANSWER' || coalesce(' (' || upper(string_split(witness, ' ')[-1]) || ')', '') END END AS named,
    CASE WHEN regexp_matches(p, '{_SPEAKER}') THEN {_strip(f"regexp_extract(p, '{_SPEAKER}', 2)")} WHEN regexp_matches(p, '{_LETTER}') THEN {_strip(r"regexp_replace(p, '(?i)^(?:BY\s+)?[QA][\.:\s]*', '')")} ELSE p END AS text
  FROM numbers n LEFT JOIN about USING (doc_id)
)""", select="SELECT doc_id, gid AS global_line_id, page, line, coalesce(last_value(named IGNORE NULLS) OVER w, CASE WHEN max(CASE WHEN text <> '' THEN 1 ELSE 0 END) OVER w = 1 THEN 'EXAMINATION' END, '') AS speaker, text, stamp AS timestamp FROM tagged WINDOW w AS (PARTITION BY doc_id ORDER BY gid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def index_pages(spark, sf_dir):
    """Page texts and blocks to canonical lines: bounds, metadata, scan, cells and speakers together."""
    return indexing.lines_of_pages(_kept(_pages(spark, sf_dir), "pages")).select("doc_id", "global_line_id", "page", "line", "speaker", "text", "timestamp")
