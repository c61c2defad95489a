"""Grid, pages, speakers, metadata and bounds."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import lines
from quire.plans import indexing
from quire.sources import transcripts
from quire.storage import Scratch

PAGES = "doc_id long, page_idx int, text string, blocks array<string>"


def cells(spark, contents, doc_id=1):
    return spark.createDataFrame([(doc_id, 0, 1, k + 1, c) for k, c in enumerate(contents)], "doc_id long, page_idx int, page int, line int, content string")


def test_parse_speakers_stamps_and_continuations(spark):
    got = lines.parse_cells(cells(spark, ["preface", "", "Q. Where? 01:17", "a loan servicer", "BY MR. X:", "", "the witness: Yes.", "Aé no tag", "plain"]), "LEE", "DOE").orderBy("line").collect()
    assert [(r.speaker, r.text, r.timestamp) for r in got] == [
        ("EXAMINATION", "preface", None), ("EXAMINATION", "", None), ("QUESTION (LEE)", "Where?", "01:17"), ("ANSWER (DOE)", "loan servicer", None),
        ("MR. X", "", None), ("MR. X", "", None), ("THE WITNESS", "Yes.", None), ("THE WITNESS", "Aé no tag", None), ("THE WITNESS", "plain", None),
    ]
    assert [r.global_line_id for r in got] == list(range(1, 10))


def test_grid_of_text(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"l{k}" for k in range(27))), (2, ""), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.global_line_id): (r.page, r.line, r.text) for r in transcripts.grid_of_text(docs).collect()}
    assert len(got) == 28 and got[1, 26] == (2, 1, "l25") and got[2, 1] == (1, 1, "")


def test_printed_page_takes_the_last_or_the_place(spark):
    df = spark.createDataFrame([("Page 3 x page 9", 0), ("none", 4)], "t string, i int")
    assert [r.p for r in df.select(transcripts.printed_page(F.col("t"), F.col("i")).alias("p")).collect()] == [9, 5]


def test_blocks_and_dense_grid(spark):
    blocks = ["3\nfirst", " 3\n later \n one ", "Page 7\n5\nno", "26\nno", "x\n4", "25\nlast"]
    pages = spark.createDataFrame([(1, 0, "Page 7", blocks)], PAGES).withColumn("page", F.lit(7))
    got = transcripts.densify(pages, transcripts.block_lines(pages)).orderBy("line").collect()
    assert len(got) == 25 and {r.line: r.content for r in got if r.content} == {3: "later one", 25: "last"}


def test_scan_stops_at_the_certificate(spark):
    rows = [(1, k, f"Page {k + 7}", []) for k in range(4)] + [(1, 4, "Certificate of Certified Shorthand Reporter Page 11", []), (1, 5, "Page 8", [])]
    got = transcripts.scan_pages(spark.createDataFrame(rows, PAGES), 8, 20).collect()
    assert sorted(r.page for r in got) == [8, 9, 10]


def test_bounds(spark):
    index = [(1, 0, "INDEX\nEXAMINATION BY MR. X .... 9\nPage 1", []), (1, 1, "Page 9", []), (1, 2, "Page 10", []), (1, 3, "WORD INDEX\nPage 11", [])]
    asked = [(2, 0, "cover\nPage 1", []), (2, 1, "1 Q. Name?\nPage 5", []), (2, 2, "Page 6", []), (2, 3, "I, Jo, DO SOLEMNLY DECLARE UNDER PENALTY\nPage 7", [])]
    neither = [(3, 0, "cover", [])]
    got = {r.doc_id: (r.start_page, r.end_page) for r in lines.testimony_bounds(spark.createDataFrame(index + asked + neither, PAGES)).collect()}
    assert got == {1: (9, 10), 2: (5, 6), 3: (7, 88)}


def test_metadata_and_defaults(spark):
    text = "In the matter of Ann Roe vs. Big Bank, Inc.\nDEPOSITION OF JANE DOE-SMITH\nTaken on May 1st, 2020\nBY MS. LEE"
    got = {r.doc_id: r for r in lines.document_metadata(spark.createDataFrame([(1, 0, text, []), (2, 0, "nothing", [])], PAGES), witness="W X").collect()}
    assert (got[1].witness, got[1].attorney, got[1].date, got[1].case_name) == ("Jane Doe-smith", "MS. LEE", "May 1st, 2020", "Ann Roe vs. Big Bank")
    assert got[2].witness == "W X" and got[2].attorney is None and got[2].case_name is None


def test_short_names_and_upload_names(spark):
    df = spark.createDataFrame([("Jane Doe", "Ms. Lee", "a/b ü?.PDF", "x")], "w string, a string, f string, g string")
    got = df.select(T.short_witness(F.col("w")), T.short_attorney(F.col("a")), transcripts.safe_upload_name(F.col("f")), transcripts.safe_upload_name(F.col("g"))).first()
    assert tuple(got) == ("DOE", "LEE", "ab ü.PDF", "x.pdf")


def test_compact_text_skips_blank_lines(spark):
    parsed = lines.parse_cells(cells(spark, ["Q. Hi", " ", "A. Yes"]), witness="DOE")
    assert lines.compact_text(parsed).first().compact == "[P01:L01] QUESTION: Hi\n[P01:L03] ANSWER (DOE): Yes"


def test_lines_of_pages_end_to_end(spark):
    rows = [(1, 0, "DEPOSITION OF ANN ROE\nBY MR. POE\nPage 1", []), (1, 1, "1 Q. Name?\nPage 2", ["1\nQ. Name?", "2\nA. Ann. 00:01"]), (1, 2, "WORD INDEX Page 3", ["1\nx"])]
    got = indexing.lines_of_pages(spark.createDataFrame(rows, PAGES)).orderBy("global_line_id").collect()
    assert len(got) == 25 and [(r.speaker, r.text, r.timestamp) for r in got[:3]] == [("QUESTION (POE)", "Name?", None), ("ANSWER (ROE)", "Ann.", "00:01"), ("ANSWER (ROE)", "", None)]


def test_read_index(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"title": "T", "witness": "W", "topics": [{"topic": "a", "start_page": 7, "verified": true}, {"topic": "b"}]}')
    got = transcripts.read_index(spark, str(tmp_path)).orderBy("candidate_id").collect()
    assert [(r.title, r.topic, r.start_page, r.verified) for r in got] == [("T", "a", 7, True), ("T", "b", None, None)]


def test_pdf_pages_by_any_reader(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    files = transcripts.read_binary(spark, str(tmp_path))
    got = transcripts.pdf_pages(files, lambda b: [(p, [p, p]) for p in b.decode().split("|")]).orderBy("page_idx").collect()
    assert [(r.page_idx, r.text, r.blocks) for r in got] == [(0, "one", ["one", "one"]), (1, "two", ["two", "two"])]


def test_a_document_over_many_ranges_is_numbered_and_carried_on(spark):
    """One huge document beside small ones and one without an id: ranges cut it, and lines and speakers go on over the cuts."""
    n = 200000
    big = spark.range(n).selectExpr("5L as doc_id", "cast(id div 25 as int) as page_idx", "cast(id % 25 + 1 as int) as line", "case when id < 70000 then '' when id % 60011 = 3 then concat('MR. ', char(65 + id % 26), ': hello') else 'words' end as content")
    small = spark.createDataFrame([(d, 0, k, c) for d in (1, 2, None) for k, c in enumerate(["", "x", "Q. why?", "so"], 1)], "doc_id long, page_idx int, line int, content string")
    cells = big.union(small).withColumn("page", F.col("page_idx") + 1)
    scratch = Scratch(spark, "test")
    got, want = scratch.keep(lines.parse_cells(cells, "LEE", "DOE", scratch), "got"), lines.parse_cells(cells, "LEE", "DOE")
    assert got.columns == want.columns and got.count() == n + 12
    assert got.exceptAll(want).count() == 0
    assert got.where("doc_id = 5").select("speaker").distinct().count() == 4
    ranges = spark.read.parquet(next(iter(scratch.paths.values()))) if scratch.paths else None
    assert ranges is not None and ranges.where("doc_id = 5").select("range").distinct().count() > 1
