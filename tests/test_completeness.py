"""No row is lost or doubled: NULL keys, several replies, documents without hits, replies that are not what was asked for."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import patterns as P
from pagewright.functions.replies import parse_flags
from pagewright.operators import logs, outline, pages, runs


@pytest.mark.parametrize("reply, named", [
    ("[1]", [1]), ("```json\n[1, 2]\n```", [1, 2]), (" [ ] ", []), ("[2.0, 3.5]", [2]), ("[1] tail", None),
    ("```json\n[1]\n``` ", None), ("[null,5]", None), ('["5"]', None), ("[1,]", None), ("[01]", None), ("{}", None),
    ("", None), (None, None)])
def test_flags_only_from_a_whole_array_of_numbers(spark, reply, named):
    row = spark.createDataFrame([(reply,)], "r string").select(parse_flags(F.col("r")).alias("v")).first()
    assert row.v == named


def test_several_replies_leave_one_page(spark):
    weak = spark.createDataFrame([(1, 1, "x" * 60, P.CORRECTING, None), (1, 2, "kept", P.COMPLETED, None)],
                                 "doc_id long, page_no int, text string, status string, method string")
    replies = spark.createDataFrame([(1, 1, "b", 1), (1, 1, "a", 2), (1, 1, None, 3), (1, 2, "c", 1)],
                                    "doc_id long, page_no int, reply string, at int")
    last = pages.apply_corrections(weak, replies, F.col("at")).orderBy("page_no").collect()
    assert [r.text for r in last] == ["a", "kept"]
    greatest = pages.apply_corrections(weak, replies).orderBy("page_no").collect()
    assert [r.text for r in greatest] == ["b", "kept"]


def test_documents_without_notes_count_zero(spark):
    df = spark.createDataFrame([(1, 1, "a{{footnote101}} b{{footnote101}} c<fn>1</fn>"), (1, 2, "none"), (2, 1, "none"),
                                (3, 1, None)], "doc_id long, page_no int, text string")
    out = sorted(map(tuple, pages.footnote_summary(df).collect()))
    assert [r[0] for r in out] == [1, 2, 3]
    assert out[0][1:] == (1, 2) and out[1:] == [(2, 0, 0), (3, 0, 0)]


def test_contents_of_a_document_without_sections(spark):
    docs = spark.createDataFrame([(1, "plain words\nmore words"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r.toc for r in outline.toc(docs).collect()}
    assert out == {1: P.TOC_BANNER, 2: P.TOC_BANNER}


def test_null_time_stays_in_the_phase_window(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "2024-01-01 00:00:00", "x"), (3, "2024-01-01 05:00:00", None)],
                               "id long, t string, message string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert sorted(r.id for r in logs.phase_window(df).collect()) == [1, 2, 3]


def test_null_run_keeps_its_steps(spark):
    df = spark.createDataFrame(
        [(None, 1, "2024-01-01 00:00:00", "a", "start"), (None, 2, "2024-01-01 03:00:00", "a", "stop"),
         (7, 3, "2024-01-01 00:00:00", "a", "start")],
        "run_id long, event_id long, t string, step_id string, action string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    out = {r.run_id: r.duration_ms for r in runs.step_durations(df).collect()}
    assert out == {None: 3 * 3_600_000, 7: None}


def test_pages_without_image_wait_and_blank_text_is_not_sent(spark):
    weak = spark.createDataFrame(
        [(1, 1, "x" * 60, True), (1, 2, "x" * 60, False), (1, 3, " " * 60, True), (1, 4, "", True), (1, 5, "x", None)],
        "doc_id long, page_no int, text string, has_image boolean").withColumns(
            {"status": F.lit(P.CORRECTING), "method": F.lit(None).cast("string")})
    replies = spark.createDataFrame([(1, n, "new") for n in (1, 2, 4, 5)], "doc_id long, page_no int, reply string")
    out = {r.page_no: (r.text, r.status, r.changes) for r in pages.apply_corrections(weak, replies).collect()}
    assert out == {1: ("new", P.COMPLETED, P.NOTE_CHANGES_MISSING), 2: ("x" * 60, P.CORRECTING, None),
                   3: (" " * 60, P.COMPLETED, "No text to process"), 4: ("new", P.COMPLETED, P.NOTE_ANALYSIS_MISSING),
                   5: ("x", P.CORRECTING, None)}


def test_notes_of_the_final_text(spark):
    parts = spark.createDataFrame([(1, 2, "<fn>a</fn>"), (1, 1, "b{{footnote7}}"), (1, 3, None), (2, 1, "none")],
                                  "doc_id long, page_no int, text string")
    finals = spark.createDataFrame([(1, "<fn>a</fn> <fn>a</fn> {{footnote9}}"), (2, "none"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: (r.footnote_count, r.pages) for r in pages.footnote_analysis(finals, parts).collect()}
    assert out[1] == (2, [1, 2]) and out[2] == (0, []) and out[3][1] == []
