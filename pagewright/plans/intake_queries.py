"""Catalogue entries of readers, writers and of rules that need inputs of their own, with their SQL twins.

The twins state patterns and texts themselves.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.formats import percent
from ..functions.replies import parse_extraction
from ..operators import footnotes, logs, pages, sessions
from ..session import run_folder, table
from ..sources import intake, sinks
from ..sources.versioned import VersionedTable
from . import derived
from .oracle_text import CONVERSATION_PAGES, FOOTNOTE_DOCS, RAW_LINES

WITH_FOOTNOTES = "WITH " + FOOTNOTE_DOCS


def pdf_inventory(spark, sf_dir):
    """Documents written as files that end in .pdf, eight folders of them, and their inventory by folder."""
    folder = run_folder(spark, "inventory")
    rows = derived.documents(spark, sf_dir).select((F.col("doc_id") % 8).alias("folder"), F.hex(F.encode(
        F.coalesce("text", F.lit("")), "UTF-8")).alias("value"))
    rows.write.partitionBy("folder").option("extension", "pdf").option("emptyValue", "").csv(folder)
    found = intake.document_inventory(spark, folder)
    named = F.regexp_extract("path", "folder=([0-9]+)/", 1).cast("long")
    return found.groupBy(named.alias("folder")).agg(
        F.sum("size").alias("bytes"), F.every(F.endswith("name", F.lit(".pdf"))).alias("all_pdf"),
        F.every(F.abs(F.unix_millis(F.current_timestamp()) - F.col("last_modified")) < 3_600_000).alias("all_new"))


PDF_INVENTORY = """SELECT doc_id % 8 AS folder, sum(2 * octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes,
true AS all_pdf, true AS all_new FROM documents GROUP BY 1"""


def text_files(spark, sf_dir):
    """Every document below its final name, twenty documents to a name, written and read back."""
    store = VersionedTable(spark, run_folder(spark, "texts"))
    name = F.concat(F.lit("doc"), F.floor(F.col("doc_id") / 20).cast("string"), F.lit(".PDF"))
    sinks.write_final_texts(derived.documents(spark, sf_dir), name, store)
    return sinks.read_texts(store).select("doc_id", "file_name", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


TEXT_FILES = """SELECT doc_id, concat('doc', doc_id // 20, '_final.txt') AS file_name, length(text) AS n_chars, md5(text) AS md5
FROM documents"""


def snapshots_cleared(spark, sf_dir):
    """Snapshots in two appends, counted and cleared, and a third append that stays."""
    store = VersionedTable(spark, run_folder(spark, "snapshots"))
    rows = derived.session_snapshots(spark, sf_dir).select("event_id", "file_id", "done_pages")
    for part in (0, 1):
        sinks.append_snapshots(rows.filter(F.col("event_id") % 3 == part), store)
    cleared = sinks.clear_tables({"snapshots": store})
    sinks.append_snapshots(rows.filter(F.col("event_id") % 3 == 2), store)
    return store.read().agg(F.count("*").alias("kept"), F.sum("done_pages").alias("done_pages")).withColumn(
        "cleared", F.lit(cleared["total"]).cast("long"))


SNAPSHOTS_CLEARED = """SELECT count(*) FILTER (WHERE event_id % 3 = 2) AS kept,
sum(event_id % 101) FILTER (WHERE event_id % 3 = 2)::BIGINT AS done_pages, count(*) FILTER (WHERE event_id % 3 < 2) AS cleared FROM events"""


def initial_pages(spark, sf_dir):
    """The first rows of documents of 2,000 characters a page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 2000).alias("n_pages"))
    return pages.new_pages(docs)


INITIAL_PAGES = """SELECT doc_id, unnest(range(1, n_chars // 2000 + 1))::INT AS page_no, 'Pending' AS status, NULL AS text,
NULL AS method FROM documents"""


def log_intake(spark, sf_dir):
    """Posted entries, some without level, message or source."""
    e = F.col("event_id")
    posted = derived.events(spark, sf_dir).select(
        e.alias("id"), F.when(e % 7 == 0, "").when(e % 11 == 0, None).otherwise(F.col("event_type")).alias("level"),
        F.when(e % 13 == 0, "").when(e % 17 == 0, None).otherwise(F.concat(F.lit("m"), e.cast("string"))).alias("message"),
        F.when(e % 5 > 0, F.lit("server")).alias("source"))
    return logs.accept_logs(posted)


LOG_INTAKE = """SELECT event_id AS id, event_type AS level, concat('m', event_id) AS message,
CASE WHEN event_id % 5 > 0 THEN 'server' ELSE 'frontend' END AS source FROM events
WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0"""


def ocr_replies(spark, sf_dir):
    """Text and notes of image replies: with an analysis, with the mark of a clean one, with neither."""
    doc, text = F.col("doc_id"), F.concat(F.lit("  "), F.col("text"))
    reply = (F.when(doc % 3 == 0, F.concat(text, F.lit("\n---OCR ANALYSIS---\nblurred\nedges\n---END ANALYSIS---\n")))
             .when(doc % 3 == 1, F.concat(F.lit("---CLEAN EXTRACTION---\n"), text)).otherwise(text))
    return derived.documents(spark, sf_dir).select("doc_id", parse_extraction(reply).alias("r")).select("doc_id", "r.*")


_SPACE = "[\\t\\n\\x0b\\x0c\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
OCR_REPLIES = f"""SELECT doc_id, regexp_replace(regexp_replace(text, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS text,
CASE doc_id % 3 WHEN 0 THEN concat('blurred', chr(10), 'edges') WHEN 1 THEN 'Clean extraction - no issues found'
ELSE 'OCR analysis not provided' END AS changes FROM documents"""


def session_progress(spark, sf_dir):
    """Completion of each user's session from the list of its finished pages (distinct pages of purchases, of 40)."""
    page = F.when(F.col("event_type") == "purchase", F.col("event_id") % 40)
    lists = derived.events(spark, sf_dir).groupBy("user_id").agg(F.collect_set(page).alias("completed"))
    return lists.select("user_id", sessions.session_completion(F.col("completed"), F.lit(40)).alias("completion"))


SESSION_PROGRESS = """SELECT user_id, floor(count(DISTINCT event_id % 40) FILTER (WHERE event_type = 'purchase') / 40 * 100 + 0.5)::BIGINT
AS completion FROM events GROUP BY user_id"""


def duplicate_notes(spark, sf_dir):
    """Footnotes whose ids repeat every eight lines: the first definition of an id counts."""
    def folded(marks: str) -> object:
        return F.regexp_replace("text", marks, r"$1$2")

    docs = derived.footnote_docs(spark, sf_dir)
    # Of the ids 100, 102, 104 ... only the last digit stays, so ids repeat.
    short = docs.withColumn("text", folded(r"(\{\{-?footnote(?:number)?)[0-9]*([0-9]\}\})"))
    return footnotes.footnote_entries(short)


DUPLICATE_NOTES = f"""WITH {RAW_LINES}, refs AS (SELECT doc_id, (100 + ln) % 10 AS id,
    row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS footnote_no FROM lines WHERE ln % 2 = 0),
defs AS (SELECT doc_id, (100 + ln) % 10 AS id, arg_min(concat(ln, ' note'), ln) AS body FROM lines WHERE ln % 4 = 0 GROUP BY 1, 2)
SELECT doc_id, footnote_no, id::VARCHAR AS orig_id, body FROM refs JOIN defs USING (doc_id, id)"""


def corrector_hook(spark, sf_dir):
    """A user's corrector over the pages of conversations: line breaks become spaces."""
    def one_line(text: pd.Series) -> pd.Series:
        return text.str.replace("\n", " ", regex=False)

    return pages.apply_corrector(derived.conversation_pages(spark, sf_dir), one_line)


CORRECTOR_HOOK = f"""WITH {CONVERSATION_PAGES} SELECT doc_id, page_no::INT AS page_no, replace(text, chr(10), ' ') AS text FROM pages_in"""


def pages_marked(spark, sf_dir):
    """Conversations as documents; flag replies name two pages each, one of which may not exist."""
    source = derived.conversation_pages(spark, sf_dir).withColumn("status", F.lit("Completed"))
    flags = source.select("doc_id").distinct().select("doc_id", F.concat(
        F.lit("```json\n["), (F.col("doc_id") % 3 + 1).cast("string"), F.lit(", "), (F.col("doc_id") % 7 + 1).cast("string"),
        F.lit("]\n```")).alias("reply"))
    listed = pages.problem_pages(source.where("false"), flags)
    return pages.mark_problem_pages(source, listed).select("doc_id", "page_no", "status")


PAGES_MARKED = f"""WITH {CONVERSATION_PAGES} SELECT doc_id, page_no::INT AS page_no,
CASE WHEN page_no IN (doc_id % 3 + 1, doc_id % 7 + 1) THEN 'AI Correction' ELSE 'Completed' END AS status FROM pages_in"""


def pages_with_images(spark, sf_dir):
    """Corrections of pages in correction: a third has no image, some texts are long but blank."""
    blank = F.when(F.col("doc_id") % 5 == 0, F.repeat(F.lit(" "), F.lit(60))).otherwise(F.col("text"))
    source = derived.conversation_pages(spark, sf_dir).select(
        "doc_id", "page_no", blank.alias("text"), F.lit("AI Correction").alias("status"), F.lit(None).cast("string").alias("method"),
        ((F.col("doc_id") + F.col("page_no")) % 3 > 0).alias("has_image"))
    replies = source.select("doc_id", "page_no", F.lit("fixed---NO CHANGES NEEDED---").alias("reply"))
    return pages.apply_corrections(source, replies).select("doc_id", "page_no", "text", "status", "method", "changes")


PAGES_WITH_IMAGES = f"""WITH {CONVERSATION_PAGES}, p AS (SELECT doc_id, page_no::INT AS page_no, (doc_id + page_no) % 3 > 0 AS image,
CASE WHEN doc_id % 5 = 0 THEN repeat(' ', 60) ELSE text END AS text, doc_id % 5 = 0 AS blank FROM pages_in)
SELECT doc_id, page_no, CASE WHEN NOT image OR blank THEN text WHEN length(text) > 50 THEN 'fixed'
  ELSE 'fixed---NO CHANGES NEEDED---' END AS text,
CASE WHEN image THEN 'Completed' ELSE 'AI Correction' END AS status,
CASE WHEN image THEN CASE WHEN length(text) > 50 THEN 'AI Correction' ELSE 'AI OCR' END END AS method,
CASE WHEN NOT image THEN NULL WHEN blank THEN 'No text to process' WHEN length(text) > 50 THEN 'No changes needed'
  ELSE 'OCR analysis not provided' END AS changes FROM p"""


def footnote_analysis(spark, sf_dir):
    """Markers in the consolidated text of ten footnote documents each, and the pages that hold any."""
    source = derived.footnote_pages(spark, sf_dir)
    found = pages.footnote_analysis(pages.consolidate(source, "spaced"), source)
    return found.withColumn("pages", F.array_join(F.transform("pages", lambda n: n.cast("string")), ","))


_MARKER = "<fn>[^\\n\\r\\x{2028}\\x{2029}]*?</fn>|\\{\\{footnote[0-9]+[^\\n\\r\\x{2028}\\x{2029}]*?\\}\\}"
FOOTNOTE_ANALYSIS = f"""{WITH_FOOTNOTES}, paged AS (SELECT doc_id // 10 AS doc_id, doc_id % 10 + 1 AS page_no, text FROM footnote_docs),
final AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text FROM paged GROUP BY doc_id),
held AS (SELECT doc_id, string_agg(page_no::VARCHAR, ',' ORDER BY page_no) AS pages FROM paged
  WHERE regexp_matches(text, '{_MARKER}') GROUP BY doc_id)
SELECT doc_id, len(list_distinct(regexp_extract_all(text, '{_MARKER}')))::BIGINT AS footnote_count, coalesce(pages, '') AS pages
FROM final LEFT JOIN held USING (doc_id)"""

QUERIES = {f.__name__: f for f in (
    pdf_inventory, text_files, snapshots_cleared, initial_pages, log_intake, ocr_replies, session_progress, duplicate_notes,
    corrector_hook, pages_marked, pages_with_images, footnote_analysis)}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
