"""Catalogue entries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, patterns as P
from ..functions.text import fragments_to_text, js_trim, preview, word_count
from ..operators import footnotes, layout, outline, pages, tags
from ..operators.chunks import page_chunks as chunk_pages, text_chunks as chunk_text
from ..session import spread, table
from . import derived, oracle_text
from .pipeline import clean_text, correct_pages, process_documents


def page_quality_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("lang", "text"))
    flags = list(pages.quality_flags(F.lit("")))
    return pages.page_quality(docs).groupBy("lang").agg(
        F.count(F.lit(1)).alias("pages"), *[F.count_if(flag).alias(f"{flag}_pages") for flag in flags],
        F.count_if("is_problem").alias("problem_pages"))


def page_issue_report(spark, sf_dir):
    return pages.issue_report(derived.document_pages(spark, sf_dir))


def page_fallback_criteria(spark, sf_dir):
    return pages.fallback_criteria(derived.document_pages(spark, sf_dir))


def document_probe(spark, sf_dir):
    return pages.probe_text(derived.documents(spark, sf_dir))


def page_routing(spark, sf_dir):
    quick = pages.route_pages(derived.document_pages(spark, sf_dir))
    both = pages.route_pages(quick.withColumnRenamed("status", "_quick"), enhanced=True)
    return both.select("doc_id", "page_no", F.col("_quick").alias("status"), "method",
                       F.col("status").alias("enhanced_status"),
                       pages.correction_method(F.col("text")).alias("correction_method"))


def page_scan(spark, sf_dir):
    """Page rows as they come from a text layer: fragments joined by one space."""
    source = derived.conversation_pages(spark, sf_dir)
    items = F.transform(F.split("text", f"[{P.JS_SPACE}]+", -1), lambda piece: F.struct(piece.alias("str")))
    return source.select("doc_id", "page_no", F.lit(P.PENDING).alias("status"),
                         fragments_to_text(items).alias("text"))


def doc_statistics(spark, sf_dir):
    return outline.doc_stats(derived.documents(spark, sf_dir))


def consolidate_pages(spark, sf_dir):
    source = derived.conversation_pages(spark, sf_dir)
    return pages.consolidate_styles(source)


def page_split_roundtrip(spark, sf_dir):
    source = derived.conversation_pages(spark, sf_dir)
    marked = pages.consolidate(source, "page_end_before").select("doc_id", "text")
    return pages.split_pages(marked).withColumn("text", js_trim(F.col("text")))


def page_chunks(spark, sf_dir):
    return chunk_pages(derived.conversation_pages(spark, sf_dir)).select(
        "doc_id", "page_no", "item_no", "chunk_no", "saves_extraction", "saves_correction")


def text_chunks(spark, sf_dir):
    return chunk_text(derived.documents(spark, sf_dir))


def previews_and_sizes(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars"))
    text, size, n_pages = F.col("text"), F.col("size"), formats.expected_minutes(F.col("words"))
    return (docs.withColumn("size", F.col("n_chars") * 700).withColumn("words", word_count(text))
            .select("doc_id", preview(text, 100).alias("preview_100"), preview(text, 300).alias("preview_300"),
                    F.left(text, F.lit(50)).alias("click_text"), formats.size_text(size).alias("size_text"),
                    formats.size_mb(size).alias("size_mb"), formats.thousands(F.col("words")).alias("words_text"),
                    formats.timer(F.col("n_chars")).alias("timer_text"),
                    pages.is_large(F.col("source"), size).alias("is_large"),
                    (n_pages > pages.ENHANCED_PAGES).alias("is_enhanced"),
                    (n_pages > pages.IMAGE_PAGES).alias("drops_images")))


def problem_pages(spark, sf_dir):
    return pages.problem_pages(derived.document_pages(spark, sf_dir), derived.page_flags(spark, sf_dir))


def _corrected(spark, sf_dir) -> DataFrame:
    return correct_pages(derived.document_pages(spark, sf_dir), derived.replies(spark, sf_dir),
                         derived.page_flags(spark, sf_dir))


def corrections_applied(spark, sf_dir):
    return _corrected(spark, sf_dir).select("doc_id", "page_no", "status", "method", "text", "changes")


def page_method_counts(spark, sf_dir):
    return pages.method_counts(_corrected(spark, sf_dir))


def pages_to_resume(spark, sf_dir):
    """Ten documents to a batch; a page counts as started once it left the extraction status."""
    batch = _corrected(spark, sf_dir).select(
        F.floor(F.col("doc_id") / 10).cast("long").alias("doc_id"),
        F.when(F.col("status") == P.PROCESSING, P.PENDING).otherwise(F.col("status")).alias("status"))
    return pages.resume_point(batch)


def outline_sections(spark, sf_dir):
    return outline.sections(derived.legal_docs(spark, sf_dir))


def outline_content(spark, sf_dir):
    return outline.section_content(derived.legal_docs(spark, sf_dir))


def outline_summary(spark, sf_dir):
    return outline.outline_summary(derived.legal_docs(spark, sf_dir))


def outline_toc(spark, sf_dir):
    return outline.toc(derived.legal_docs(spark, sf_dir))


def outline_filter(spark, sf_dir):
    """Annexes out; of the other sections three are toggled once and one twice."""
    clicks = F.array(*[F.lit(n).cast("long") for n in (1, 2, 2, 5, 9)])
    filtered = outline.exclude_sections(derived.legal_docs(spark, sf_dir), annexes=True, ids=outline.toggled(clicks))
    named = outline.filtered_files(filtered, F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".PDF")))
    return named.select("doc_id", "excluded_annexes", "excluded_sections", "kept_lines", "text", "file_name")


def tag_blocks(spark, sf_dir):
    return tags.blocks(derived.tagged_pages(spark, sf_dir))


def tag_block_join(spark, sf_dir):
    docs = derived.tagged_docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit(">\n<"), F.lit("><")))
    return tags.join_blocks(docs).withColumn("footnotes", F.array_join("footnotes", "\n"))


def footnote_tagging(spark, sf_dir):
    return tags.format_tagged(derived.tagged_docs(spark, sf_dir))


def footnote_renumber(spark, sf_dir):
    return footnotes.renumber_footnotes(derived.footnote_docs(spark, sf_dir))


def footnote_entries(spark, sf_dir):
    return footnotes.footnote_entries(derived.footnote_docs(spark, sf_dir))


def footnote_pages(spark, sf_dir):
    return pages.footnote_summary(derived.footnote_pages(spark, sf_dir))


def footnote_page_list(spark, sf_dir):
    return pages.note_markers(derived.footnote_pages(spark, sf_dir)).withColumn("markers", F.size("markers").cast("long"))


def drop_number_lines(spark, sf_dir):
    return footnotes.drop_number_lines(derived.legal_docs(spark, sf_dir))


def align_line_types(spark, sf_dir):
    return layout.classify_lines(derived.legal_docs(spark, sf_dir))


def align_merge(spark, sf_dir):
    return layout.merge_lines(derived.legal_docs(spark, sf_dir))


def align_render(spark, sf_dir):
    return layout.align(derived.legal_docs(spark, sf_dir))


def pipeline_text(spark, sf_dir):
    return clean_text(derived.footnote_docs(spark, sf_dir))


def document_pipeline(spark, sf_dir):
    """Pages with replies, all the way to clean text."""
    return process_documents(derived.document_pages(spark, sf_dir), derived.replies(spark, sf_dir),
                             derived.page_flags(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    page_quality_by_lang, page_issue_report, page_fallback_criteria, document_probe, page_routing, page_scan,
    doc_statistics, consolidate_pages, page_split_roundtrip, page_chunks, text_chunks, previews_and_sizes,
    problem_pages, corrections_applied, page_method_counts, pages_to_resume, outline_sections, outline_content,
    outline_summary, outline_toc, outline_filter, tag_blocks, tag_block_join, footnote_tagging, footnote_renumber,
    footnote_entries, footnote_pages, footnote_page_list, drop_number_lines, align_line_types, align_merge,
    align_render, pipeline_text, document_pipeline)}
ORACLES = {name: getattr(oracle_text, name.upper()) for name in QUERIES}
