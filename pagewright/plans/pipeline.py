"""The text pipeline in its fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import pages as page_ops
from ..operators.footnotes import drop_number_lines, renumber_footnotes
from ..operators.layout import align


def clean_text(docs: DataFrame) -> DataFrame:
    """Footnotes, then layout, then number lines. A narrow plan: no shuffle at any step."""
    return docs.transform(renumber_footnotes).transform(align).transform(drop_number_lines)


def correct_pages(pages: DataFrame, replies: DataFrame, flag_replies: DataFrame | None = None) -> DataFrame:
    """Route pages, find the weak ones and put in the corrections that exist for them.

    The page key stays the partitioning from the first join on, so page text is shuffled once.
    """
    routed = page_ops.route_pages(pages)
    listed = page_ops.problem_pages(pages, flag_replies)
    return page_ops.apply_corrections(page_ops.mark_problem_pages(routed, listed), replies)


def process_documents(pages: DataFrame, replies: DataFrame, flag_replies: DataFrame | None = None) -> DataFrame:
    """From page text and correction replies to clean document text, ``doc_id, part_no, text``."""
    corrected = correct_pages(pages, replies, flag_replies)
    return page_ops.consolidate(corrected).transform(clean_text)
