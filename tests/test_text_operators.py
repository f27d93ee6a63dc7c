"""Golden cases of pages, outline, footnotes, tags, replies and formats."""

import itertools

import pytest
from pyspark.sql import functions as F

from pagewright.functions import formats, replies
from pagewright.functions.text import running, universal_lines
from pagewright.operators import chunks, footnotes, outline, pages, tags


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def value(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], list(cells))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("text, expected", [
    ("A{{footnotenumber7}} B{{footnotenumber3}}{{footnote3}} x {{-footnote3}}{{footnote7}}y{{-footnote7}}",
     "A1 B2\n\nFOOTNOTES:\n1. y\n2. x\n"),
    ("a{{footnotenumber3}}{{footnote3}}p{{-footnote3}}{{footnote3}}q{{-footnote3}}", "a1\n\nFOOTNOTES:\n1. p\n"),
    ("a{{footnote3}}p\nq{{-footnote9}}b", "ab\n\nFOOTNOTES:\n"),
    ("a{{footnotenumber3}}b", "a1b"),
    ("a{{footnotenumber07}}{{footnote7}} $1 {{-footnote7}}", "a1\n\nFOOTNOTES:\n1. $1\n"),
    ("plain", "plain"),
])
def test_renumber(spark, text, expected):
    assert footnotes.renumber_footnotes(docs(spark, text)).first().text == expected


def test_renumber_strip_closing(spark):
    text = "a{{footnotenumber3}}x{{-footnotenumber3}}"
    assert footnotes.renumber_footnotes(docs(spark, text)).first().text == "a1x{{-footnotenumber3}}"
    assert footnotes.renumber_footnotes(docs(spark, text), strip_closing=True).first().text == "a1x"


@pytest.mark.parametrize("text, expected", [
    ("a\n 12 \nb", "a\nb"), ("a\r\n7\r\n", "a"), ("a\n\nb\n", "a\n\nb"), ("", ""), ("5", "")])
def test_drop_number_lines(spark, text, expected):
    assert footnotes.drop_number_lines(docs(spark, text)).first().text == expected


def test_universal_lines(spark):
    for text in ["a\nb", "a\n", "\n", "", "a\x0bb\x1cc\x85d\u2028e\r\nf\rg", "\n\n a"]:
        assert value(spark, universal_lines(F.col("t")), t=text) == text.splitlines()


OUTLINE_TEXT = "CHAPTER 1\nfoo bar\nDefinitions\nbaz\nANNEX A\nqux"


def test_outline(spark):
    rows = outline.sections(docs(spark, OUTLINE_TEXT)).orderBy("section_no").collect()
    assert [(r.type, r.level, r.start_line, r.end_line, r.word_count) for r in rows] == [
        ("heading", 1, 1, 4, 6), ("section", 2, 3, 4, 2), ("annex", 1, 5, 6, 3)]
    assert [r.section_id for r in rows] == ["section-0", "section-1", "section-2"]


def test_ten_capitals_end_but_start_nothing(spark):
    rows = outline.sections(docs(spark, "CHAPTER 1\nx\nABCDEFGHIJ\ny\nABCDEFGHIJK")).orderBy("section_no").collect()
    assert [(r.start_line, r.end_line) for r in rows] == [(1, 2), (5, 5)]


def test_exclusions(spark):
    df = docs(spark, OUTLINE_TEXT)
    ids = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))
    assert outline.exclude_sections(df, annexes=True).first().text == "CHAPTER 1\nfoo bar\nDefinitions\nbaz"
    assert outline.exclude_sections(df, ids=ids).first().text == "CHAPTER 1\nfoo bar\nANNEX A\nqux"
    assert outline.exclude_sections(df).first().text == OUTLINE_TEXT
    row = outline.exclude_sections(df, annexes=True, ids=F.array(F.lit(0).cast("long"))).first()
    assert (row.text, row.kept_lines, row.excluded_annexes, row.excluded_sections, row.total_lines) == ("", 0, 1, 1, 6)
    assert outline.exclude_sections(df, ids=F.lit(None).cast("array<bigint>")).first().text == OUTLINE_TEXT


def test_toggles(spark):
    numbers = F.array(*[F.lit(n).cast("long") for n in (5, 1, 5, 2, 5, 1)])
    assert sorted(value(spark, outline.toggled(numbers), x=1)) == [2, 5]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
def test_running_sums(spark, size):
    numbers = [i * 7 % 11 for i in range(size)]
    frame = spark.createDataFrame([(numbers,)], "n array<bigint>")
    assert frame.select(running(F.col("n")).alias("s")).first().s == list(itertools.accumulate(numbers))


def test_outline_needs_no_shuffle_and_survives_long_texts(spark):
    """20,000 lines and half as many sections in a row; no exchange in any outline operator."""
    text = "\n".join(f"Article {i}" if i % 2 else "some words here" for i in range(20_000))
    df = docs(spark, text).union(docs(spark, None))
    for made in (outline.sections(df), outline.section_content(df), outline.toc(df), outline.outline_summary(df),
                 outline.exclude_sections(df, annexes=True, ids=F.array(F.lit(0).cast("long")))):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert outline.sections(df).agg(F.sum("word_count"), F.count("*")).first() == (20_000 + 30_000 - 3, 10_000)
    kept = {r.total_lines: r.kept_lines for r in outline.exclude_sections(df, ids=F.array(F.lit(0).cast("long"))).collect()}
    assert kept == {20_000: 19_998, None: None}


@pytest.mark.parametrize("annex, section, expected", [
    (2, 0, "x_without_2_annexes.txt"), (1, 3, "x_without_1_annexes_and_without_3_sections.txt"), (0, 0, "x_complete.txt")])
def test_filtered_name(spark, annex, section, expected):
    assert value(spark, formats.filtered_name(F.col("n"), F.col("a"), F.col("s")), n="x.PDF", a=annex, s=section) == expected


def test_toc(spark):
    assert outline.toc(docs(spark, OUTLINE_TEXT)).first().toc == (
        "TABLE OF CONTENTS\n==================\n\nCHAPTER 1 (Line 1)\n  Definitions (Line 3)\nANNEX A (Line 5)\n")


@pytest.mark.parametrize("text, expected, count", [
    ("<h>Art 1</h><p>x<fn>[3] note</fn></p>",
     "Art 1\n\nx{{footnotenumber1}}[3]{{-footnotenumber1}}\n\n{{footnote1}}[3] note{{-footnote1}}", 1),
    ("<p>x</p><fn>1 n</fn>", "x\n\n{{footnote1}}1 n{{-footnote1}}", 1),
    ("<p>a\nb</p> lost <li>c<fn>note</fn></li>",
     "a b\n\nc{{footnotenumber1}}[1]{{-footnotenumber1}}\n\n{{footnote1}}note{{-footnote1}}", 1),
    ("<p>__FOOTNOTE_REF_1__ __FOOTNOTE_REF_9__<fn>²x</fn></p>",
     "{{footnotenumber1}}²{{-footnotenumber1}} __FOOTNOTE_REF_9____FOOTNOTE_REF_1__\n\n{{footnote1}}²x{{-footnote1}}", 1),
    ("no blocks", "", 0),
])
def test_format_tagged(spark, text, expected, count):
    row = tags.format_tagged(docs(spark, text)).first()
    assert (row.text, row.footnote_count) == (expected, count)


@pytest.mark.parametrize("text, expected", [
    ("<h>A</h><p>b</p><p>c</p>", "A\n\nb\n\nc"), ("<li>a</li><li>b</li>", "a\nb"), ("<p>a</p>\n<p>b</p>", "ab"),
    ("<p>a</p> x <li>b</li><p>c<fn>1 n</fn></p>", "abc{{footnotenumber1}}")])
def test_join_blocks(spark, text, expected):
    assert tags.join_blocks(docs(spark, text)).first().text == expected


def test_clean_note_keeps_words(spark):
    for note, clean in [("12 Hello", "Hello"), ("Hello", "Hello"), ("[3] x", "x"), ("(4) y", "y"), ("* z", "z"), ("a b", "b")]:
        assert value(spark, tags.clean_note(F.col("n")), n=note) == clean


def test_replies(spark):
    def parsed(parse, text):
        return tuple(value(spark, parse(F.col("r")), r=text))
    assert parsed(replies.parse_correction, "t \n---NO CHANGES NEEDED---") == ("t", "No changes needed")
    assert parsed(replies.parse_correction, "t $1\n---CHANGES MADE---\n a\n---END CHANGES---") == ("t $1", "a")
    assert parsed(replies.parse_correction, "t") == ("t", "Changes summary not provided")
    assert parsed(replies.parse_extraction, "t---CLEAN EXTRACTION---") == ("t", "Clean extraction - no issues found")
    assert parsed(replies.parse_extraction, "---OCR ANALYSIS---x---END ANALYSIS---t") == ("t", "x")
    assert value(spark, replies.parse_flags(F.col("r")), r="```json\n[1,2]\n```") == [1, 2]
    assert value(spark, replies.parse_flags(F.col("r")), r="sorry") is None


def test_flag_union(spark):
    clean = "Fine words here. " * 20
    table = spark.createDataFrame([(0, 1, clean), (0, 2, "short"), (0, 3, "tiny"), (0, 4, clean)],
                                  "doc_id long, page_no int, text string")
    flags = spark.createDataFrame([(0, "```json\n[1,2]\n```")], "doc_id long, reply string")
    assert sorted(r.page_no for r in pages.problem_pages(table, flags).collect()) == [1, 2, 3]
    assert sorted(r.page_no for r in pages.problem_pages(table).collect()) == [2, 3]


def test_limits(spark):
    table = spark.createDataFrame([(0, 1, "x" * 200), (0, 2, "y" * 201), (0, 3, " "), (0, 4, "z" * 199)],
                                  "doc_id long, page_no int, text string")
    routed = {r.page_no: r.method for r in pages.route_pages(table).collect()}
    assert routed == {1: None, 2: "Quick Text", 3: None, 4: None}
    short = {r.page_no: r.short for r in pages.page_quality(table).collect()}
    assert short == {1: False, 2: False, 4: True}


def test_split_join_round_trip(spark):
    table = spark.createDataFrame([(0, n, f"page {n}") for n in range(1, 6)], "doc_id long, page_no int, text string")
    whole = pages.consolidate(table, "page_end_before").select("doc_id", "text")
    parts = pages.split_pages(whole).orderBy("page_no").collect()
    assert [p.text.strip() for p in parts] == [""] + [f"page {n}" for n in range(1, 6)]
    in_parts = pages.consolidate(table, "plain", pages_per_part=2).orderBy("part_no").collect()
    assert "\n".join(p.text for p in in_parts) == "\n".join(f"page {n}" for n in range(1, 6))


def test_corrector_hook(spark):
    table = spark.createDataFrame([(0, 1, "abc")], "doc_id long, page_no int, text string")
    assert pages.apply_corrector(table, lambda text: text.str.upper()).first().text == "ABC"


def test_new_and_pending_pages(spark):
    fresh = pages.new_pages(spark.createDataFrame([(0, 3), (1, 0)], "doc_id long, n_pages int"))
    done = spark.createDataFrame([(0, 2)], "doc_id long, page_no int")
    assert sorted(r.page_no for r in pages.pending_pages(fresh, done).collect()) == [1, 3]
    assert {r.status for r in fresh.collect()} == {"Pending"}


def test_chunks(spark):
    df = docs(spark, "x" * 70_001, "", "y" * 30_000)
    cut = chunks.text_chunks(df)
    assert [r.n for r in cut.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy("doc_id").collect()] == [3, 1, 1]
    back = {r.doc_id: r.text for r in chunks.rejoin_chunks(cut).collect()}
    assert back[0].replace("\n", "") == "x" * 70_001


@pytest.mark.parametrize("ms, words, clock", [
    (500, "0s", "500ms"), (5000, "5s", "5s"), (65_000, "1m 5s", "1:05"), (3_725_000, "1h 2m", "1:02:05")])
def test_durations(spark, ms, words, clock):
    assert value(spark, formats.duration_words(F.col("m")), m=ms) == words
    assert value(spark, formats.duration_clock(F.col("m")), m=ms) == clock


def test_sizes(spark):
    assert value(spark, formats.size_text(F.col("s")), s=3 * 1024 * 1024) == "3.00 MB"
    assert value(spark, formats.size_text(F.col("s")), s=2048) == "2.00 KB"
    assert value(spark, formats.size_mb(F.col("s")), s=int(2.5 * 1024 * 1024)) == "2.5 MB"
    assert value(spark, formats.step_label(F.col("n")), n="Phase 1 - 3/5") == "Phase 1"


def test_long_documents_are_one_text(spark):
    table = spark.range(1, 25_001).selectExpr("1L AS doc_id", "id AS page_no", "concat('page ', id) AS text")
    rows = pages.consolidate(table).collect()
    assert len(rows) == 1 and rows[0].text.count("page ") == 25_000 and rows[0].text.endswith("page 25000")
