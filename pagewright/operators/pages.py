"""Page tables: quality, routing, splitting, consolidation and corrections.

A page table has ``doc_id, page_no, text`` and, once routed, ``status, method``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.replies import parse_correction, parse_extraction, parse_flags
from ..functions.text import js_trim
from .rows import unnest

KEYS = ["doc_id", "page_no"]
LARGE_BYTES, ENHANCED_PAGES, IMAGE_PAGES = 10 * 1024 * 1024, 50, 100


def is_large(name: Column, size: Column) -> Column:
    """Large by size or by a name that says so."""
    return (size > LARGE_BYTES) | F.contains(F.lower(name), F.lit("large"))


def new_pages(documents: DataFrame) -> DataFrame:
    """Rows 1..n_pages in the initial state, from ``doc_id, n_pages``."""
    return (documents.filter(F.col("n_pages") > 0)
            .select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("page_no"))
            .select("doc_id", "page_no", F.lit(P.PENDING).alias("status"), F.lit(None).cast("string").alias("text"),
                    F.lit(None).cast("string").alias("method")))


def quality_flags(trimmed: Column) -> dict[str, Column]:
    """The five quality rules on trimmed page text."""
    size = F.length(trimmed)
    tokens = F.regexp_count(trimmed, F.lit(f"[{P.JS_SPACE}]+")) + 1
    return {
        "short": size < 200,
        "odd_breaks": F.regexp_count(trimmed, F.lit(P.ODD_LINE_BREAK)) > 3,
        "missing_spaces": F.regexp_count(trimmed, F.lit(P.MISSING_SPACE)) > 5,
        "special_chars": F.regexp_count(trimmed, F.lit(P.SPECIAL_CHAR)) > size * F.lit(0.05).cast("double"),
        "fragmented": F.regexp_count(trimmed, F.lit(P.SHORT_WORD)) > tokens * F.lit(0.3).cast("double"),
    }


def page_quality(pages: DataFrame, text: str = "text") -> DataFrame:
    """Non-empty pages with their quality flags and ``is_problem``; row-local."""
    flags = quality_flags(F.col("_t"))
    checked = _not_blank(pages, text).withColumn("_t", js_trim(F.col(text))).withColumns(flags).drop("_t")
    return checked.withColumn("is_problem", _any(flags))


def _not_blank(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with any visible character, which a search finds at the start of the text."""
    return pages.filter(F.rlike(text, F.lit(f"[^{P.JS_SPACE}]")))


def _any(names) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | F.col(name)
    return found


def _issue_names() -> Column:
    flag = quality_flags(F.col("_t"))
    return F.concat_ws(
        ", ",
        F.when(flag["short"], P.ISSUE_SHORT), F.when(flag["odd_breaks"], P.ISSUE_ODD_BREAKS),
        F.when(flag["missing_spaces"], P.ISSUE_MISSING_SPACES),
        F.when(flag["special_chars"], P.ISSUE_SPECIAL_CHARS), F.when(flag["fragmented"], P.ISSUE_FRAGMENTED))


def issue_report(pages: DataFrame) -> DataFrame:
    """One line per problem page, naming its issues."""
    return _with_issues(pages, _issue_names()).select(
        *KEYS, F.concat(F.lit("Página "), F.col("page_no").cast("string"), F.lit(": "), F.col("issues")).alias("report"))


def _with_issues(pages: DataFrame, issues: Column) -> DataFrame:
    """Pages for which ``issues`` (over the trimmed text ``_t``) is not empty.

    Filtering inside an array keeps the test next to the value; a plain filter would be pushed down
    and judge every page a second time.
    """
    trimmed = _not_blank(pages).select(*KEYS, js_trim(F.col("text")).alias("_t"))
    return unnest(trimmed, KEYS, F.filter(F.array(issues), lambda found: found != ""), "issues").drop("_pos")


def local_problem_pages(pages: DataFrame) -> DataFrame:
    return _with_issues(pages, _issue_names()).select(*KEYS)


def problem_pages(pages: DataFrame, flag_replies: DataFrame | None = None) -> DataFrame:
    """Locally flagged pages plus those named in ``flag_replies(doc_id, reply)``, distinct."""
    local = local_problem_pages(pages)
    if flag_replies is None:
        return local.distinct()
    named = flag_replies.select("doc_id", F.explode(parse_flags(F.col("reply"))).alias("page_no"))
    return local.union(named.filter(F.col("page_no").isNotNull())).distinct()


def fallback_criteria(pages: DataFrame) -> DataFrame:
    """Extra criteria, applied to documents in which the main rules flag no page."""
    flagged = local_problem_pages(pages).select("doc_id").distinct()
    t = F.col("_t")
    issues = F.concat_ws(
        ", ",
        F.when(F.length(t) < 150, P.FALLBACK_SHORT),
        F.when(F.regexp_count(t, F.lit(f"[{P.JS_SPACE}]+")) + 1 < 20, P.FALLBACK_FEW_WORDS),
        F.when(F.regexp_count(t, F.lit(P.ODD_LINE_BREAK)) > 2, P.FALLBACK_ODD_BREAKS),
        F.when(F.contains(t, F.lit("□")) | F.contains(t, F.lit("■")), P.FALLBACK_PLACEHOLDER),
        F.when(F.rlike(F.left(t, F.lit(100)), F.lit(r"[^\x00-\x7F]")), P.FALLBACK_NON_ASCII))
    # Only the issue text travels to the join, not the page text.
    return _with_issues(pages, issues).join(flagged, "doc_id", "left_anti")


def probe_text(docs: DataFrame) -> DataFrame:
    """Whole-document probe on the raw text, with the three-way sufficiency verdict."""
    t = F.col("text")

    def counted(pattern: str, limit: int, label: str) -> Column:
        n = F.regexp_count(t, F.lit(pattern))
        return F.when(n > limit, F.concat(F.lit(label), n.cast("string")))

    issues = F.concat_ws(
        ", ", F.when(F.length(t) < 100, P.PROBE_SHORT), counted(P.SPECIAL_CHAR, 10, P.PROBE_SPECIAL),
        counted(P.NUMBER_RUN, 5, P.PROBE_NUMBERS), counted(P.ODD_LINE_BREAK, 3, P.PROBE_BREAKS))
    return docs.select("doc_id", issues.alias("issues"), sufficiency(t).alias("sufficiency"))


def sufficiency(text: Column) -> Column:
    return (F.when(F.length(text) > 100, P.SUFFICIENT).when(F.length(text) > 0, P.LITTLE_TEXT).otherwise(P.NO_TEXT))


def route_pages(pages: DataFrame, enhanced: bool = False) -> DataFrame:
    """Status and method after extraction. The enhanced rule has a lower limit and names no method."""
    size = F.length(js_trim(F.col("text")))
    if enhanced:
        return pages.withColumn("status", F.when(size > 100, P.COMPLETED).otherwise(P.PENDING))
    return (pages.withColumn("status", F.when(size > 200, P.COMPLETED).otherwise(P.PROCESSING))
            .withColumn("method", F.when(size > 200, P.QUICK_TEXT)))


def correction_method(text: Column) -> Column:
    return F.when(F.length(text) > 50, P.AI_CORRECTION).otherwise(P.AI_OCR)


def mark_problem_pages(pages: DataFrame, problems: DataFrame) -> DataFrame:
    """Set the correcting status on the listed pages; the others keep theirs."""
    listed = problems.select(*KEYS).distinct().withColumn("_listed", F.lit(True))
    return (pages.join(listed, KEYS, "left")
            .withColumn("status", F.when(F.col("_listed"), P.CORRECTING).otherwise(F.col("status"))).drop("_listed"))


def apply_corrections(pages: DataFrame, replies: DataFrame, arrival: Column | None = None) -> DataFrame:
    """Put corrected text on pages in correction; the rest keep their own.

    Of several ``replies(doc_id, page_no, reply)`` for a page the last by ``arrival`` counts, without one
    the greatest text. NULL replies are none. Pages keep their number whatever the replies are.

    Where pages say so in a column ``has_image``, those without an image are passed over and keep waiting.
    Long but blank text is not sent: the page keeps it, with a note that there was none.
    """
    latest = replies.filter(F.col("reply").isNotNull()).groupBy(*KEYS).agg(
        F.max_by("reply", F.struct(F.col("reply") if arrival is None else arrival, "reply")).alias("reply"))
    waiting = F.col("status") == P.CORRECTING
    if "has_image" in pages.columns:
        waiting = waiting & F.coalesce("has_image", F.lit(False))
    method = correction_method(F.col("text"))
    blank = (method == P.AI_CORRECTION) & ~F.rlike("text", F.lit(f"[^{P.JS_SPACE}]"))
    unsent = F.struct(F.col("text").alias("text"), F.lit(P.NOTE_NO_TEXT).alias("changes"))
    # Routing decides which grammar the reply follows, so parsing comes after the join.
    parsed = F.when(method == P.AI_CORRECTION, parse_correction(F.col("reply"))).otherwise(
        parse_extraction(F.col("reply")))
    done = F.col("_fix").isNotNull()
    return (pages.join(latest, KEYS, "left")
            .withColumn("_fix", F.when(waiting & blank, unsent).when(waiting & F.col("reply").isNotNull(), parsed))
            .withColumn("method", F.when(done, method).otherwise(F.col("method")))
            .withColumn("status", F.when(done, P.COMPLETED).otherwise(F.col("status")))
            .withColumn("text", F.when(done, F.col("_fix.text")).otherwise(F.col("text")))
            .withColumn("changes", F.col("_fix.changes"))
            .drop("_fix", "reply"))


def apply_corrector(pages: DataFrame, corrector: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Hook for a user's own page corrector, called with Arrow-sized batches of page text."""
    names = pages.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=corrector(batch["text"]))[names]

    return pages.mapInPandas(run, pages.schema)


def method_counts(pages: DataFrame) -> DataFrame:
    """Pages in total, by method, in error and touched by a model."""
    method = F.col("method")
    return pages.agg(
        F.count(F.lit(1)).alias("pages_analyzed"),
        F.count_if(method == P.AI_OCR).alias("ocr_pages"),
        F.count_if(method == P.AI_CORRECTION).alias("correction_pages"),
        F.count_if(method == P.QUICK_TEXT).alias("quick_text_pages"),
        F.count_if(F.col("status") == P.ERROR).alias("error_pages"),
        F.count_if(method.isin(P.AI_CORRECTION, P.AI_OCR)).alias("model_pages"))


def resume_point(pages: DataFrame) -> DataFrame:
    """Pages already past the initial state and whether extraction is complete."""
    started = F.col("status") != P.PENDING
    return pages.groupBy("doc_id").agg(F.count_if(started).alias("start_from"), F.every(started).alias("all_extracted"))


def pending_pages(pages: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Pages that no snapshot holds yet."""
    return pages.join(snapshots.select(*KEYS).distinct(), KEYS, "left_anti")


def split_pages(docs: DataFrame) -> DataFrame:
    """Pages between end-of-page marks, numbered by position."""
    return (unnest(docs, ["doc_id"], F.split("text", P.PAGE_END_MARK, -1), "text", "page_no")
            .select("doc_id", "page_no", "text")
            .withColumn("page_no", F.col("page_no") + 1))


#: How one page is written in each consolidation style, and what stands between pages.
STYLES: dict[str, tuple[Callable[[Column, Column], Column], str]] = {
    "plain": (lambda text, no: text, "\n"),
    "spaced": (lambda text, no: text, "\n\n"),
    "page_after": (lambda text, no: F.when(text == "", "").otherwise(
        F.concat(text, F.lit("\n\n--- PAGE "), no, F.lit(" ---\n\n"))), ""),
    "page_end_before": (lambda text, no: F.concat(F.lit("--- END OF PAGE "), no, F.lit(" ---\n"), text), "\n\n"),
    "page_before": (lambda text, no: F.concat(F.lit("--- PAGE "), no, F.lit(" ---\n"), text), "\n\n"),
}


def _parts(pages: DataFrame, styles: list[str], pages_per_part: int | None) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))

    def joined(style: str) -> Column:
        write, separator = STYLES[style]
        return F.array_join(F.transform("_pages", lambda page: write(page["text"], page["page_no"].cast("string"))),
                            separator).alias(style)

    part = F.lit(0) if pages_per_part is None else F.floor((F.col("page_no") - 1) / pages_per_part)
    return (pages.select("doc_id", part.cast("long").alias("part_no"), "page_no", F.coalesce("text", F.lit("")).alias("text"))
            .groupBy("doc_id", "part_no").agg(ordered.alias("_pages"))
            .select("doc_id", "part_no", *[joined(style) for style in styles]))


def consolidate(pages: DataFrame, style: str = "plain", pages_per_part: int | None = None) -> DataFrame:
    """Document text in page order, as ``doc_id, part_no, text``.

    A document is one row, part 0. Only where a caller asks for ``pages_per_part`` does a longer one come in several
    parts, which joined in order by the style's separator are its whole text; parts are for storage, not for further
    operators, as notes and line context run over their ends.
    """
    return _parts(pages, [style], pages_per_part).withColumnRenamed(style, "text")


def consolidate_styles(pages: DataFrame, pages_per_part: int | None = None) -> DataFrame:
    """Every style side by side from one grouping."""
    return _parts(pages, list(STYLES), pages_per_part)


def note_markers(pages: DataFrame) -> DataFrame:
    """Pages that hold footnote markers, with the distinct markers on each."""
    return (pages.select(*KEYS, F.array_distinct(F.regexp_extract_all("text", F.lit(P.NOTE_MARKER), F.lit(0)))
                         .alias("markers"))
            .filter(F.size("markers") > 0))


def footnote_summary(pages: DataFrame) -> DataFrame:
    """Distinct footnote markers and pages with any, per document.

    Distinct counting is by (document, marker), so a large document spreads over many tasks. The
    first marker of a page stands for the page, so one pass counts both. Pages without notes keep a row
    with a NULL marker, so that a document without any has zeros.
    """
    markers = F.array_distinct(F.regexp_extract_all("text", F.lit(P.NOTE_MARKER), F.lit(0)))
    per_marker = (pages.select("doc_id", F.posexplode_outer(markers).alias("_pos", "marker"))
                  .groupBy("doc_id", "marker")
                  .agg(F.count_if(F.col("_pos") == 0).alias("_pages")))
    return per_marker.groupBy("doc_id").agg(
        F.sum("_pages").alias("pages_with_notes"), F.count("marker").alias("footnote_count"))


def footnote_analysis(finals: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct footnote markers in the final text of each document, and the pages that hold any, in ascending order.

    Page numbers are collected per document, not their texts; documents without a final text are left out.
    """
    marker = F.lit(P.NOTE_MARKER)
    holding = (pages.filter(F.rlike("text", marker)).groupBy("doc_id")
               .agg(F.sort_array(F.collect_set("page_no")).alias("pages")))
    counted = finals.select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("text", marker, F.lit(0)))).cast("long").alias("footnote_count"))
    return counted.join(holding, "doc_id", "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<int>")))
