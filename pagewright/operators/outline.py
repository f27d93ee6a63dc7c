"""Document outline: sections, table of contents, statistics and section filters.

The outline is an array made inside the document row, and what follows from it (contents, table of contents, counts,
filtered text) is made there too: nothing here shuffles. Counts along the lines are running sums (:func:`~.text.running`),
so the cost is linear in the lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.formats import filtered_name
from ..functions.text import js_trim, let, lines, preview, running, word_count
from .rows import unnest


def section_kind(line: Column) -> Column:
    """``struct<type, level>`` of a trimmed line, NULL where it opens no section."""
    def kind(name: str, level: int) -> Column:
        return F.struct(F.lit(name).alias("type"), F.lit(level).alias("level"))

    def hit(pattern: str) -> Column:
        return F.rlike(line, F.lit(pattern))

    return (F.when((F.length(line) < 3) | ~hit(P.OPENING_LINE), None)
            .when(hit(P.MAIN_HEADING), kind("heading", 1)).when(hit(P.ANNEX_HEADING), kind("annex", 1))
            .when(hit(P.SUB_HEADING) | hit(P.NUMBERED_HEADING), kind("section", 2))
            .when((F.length(line) > 10) & hit(P.ALL_CAPS_TITLE), kind("heading", 1))
            .when(hit(P.DEFINITIONS_HEADING), kind("section", 2)))


def closes_section(line: Column) -> Column:
    """Whether a trimmed line ends the section above it (a narrower rule than opening one)."""
    return (F.length(line) >= 3) & F.rlike(line, F.lit(P.CLOSING_LINE))


def outline_of(text_lines: Column) -> Column:
    """The sections of a document's lines, in order: number, id, title, level, type, lines from start to end (from 1), words."""
    def flag(test: Column) -> Column:
        return F.when(test, 1).otherwise(0).cast("long")

    judged = F.transform(text_lines, lambda line, i: let(js_trim(line), lambda title: F.struct(
        i.alias("at"), title.alias("title"), section_kind(title).alias("kind"), closes_section(title).alias("closes"))))
    marks = F.filter(judged, lambda mark: mark["kind"].isNotNull() | mark["closes"])

    def sections_of(found: Column, closing: Column, words: Column) -> Column:
        counted = F.arrays_zip(
            found.alias("mark"),
            running(F.transform(found, lambda mark: flag(mark["kind"].isNotNull()))).alias("opened"),
            running(F.transform(found, lambda mark: flag(mark["closes"]))).alias("closed"))

        def section(z: Column) -> Column:
            mark, number = z["mark"], z["opened"] - 1
            # The section ends before the first closing line behind its own.
            end = F.coalesce(F.get(closing, z["closed"].cast("int"))["at"], F.size(text_lines))
            before = F.coalesce(F.get(words, mark["at"] - 1), F.lit(0).cast("long"))
            return F.struct(
                number.alias("section_no"), F.concat(F.lit("section-"), number.cast("string")).alias("section_id"),
                mark["title"].alias("title"), mark["kind"]["level"].alias("level"), mark["kind"]["type"].alias("type"),
                (mark["at"] + 1).alias("start_line"), end.alias("end_line"),
                (F.get(words, end - 1) - before).alias("word_count"))

        return F.transform(F.filter(counted, lambda z: z["mark"]["kind"].isNotNull()), section)

    return let(marks, lambda found: let(F.filter(found, lambda mark: mark["closes"]), lambda closing: let(
        running(F.transform(text_lines, word_count)), lambda words: sections_of(found, closing, words))))


def _with_lines(body: Callable[[Column, Column], Column]) -> Column:
    """A value from the lines of the text and their outline, each worked out once."""
    return let(lines(F.col("text")), lambda found: let(outline_of(found), lambda sections_: body(found, sections_)))


def sections(docs: DataFrame) -> DataFrame:
    """One row per section: number, title, level, type, line range (from 1) and words."""
    found = _with_lines(lambda _, sections_: sections_)
    return unnest(docs, ["doc_id"], found, "s").select("doc_id", "s.*")


def section_content(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Sections with their text, cut from the document row; ``limit`` gives a preview instead."""
    def cut(text_lines: Column, section: Column) -> Column:
        size = section["end_line"] - section["start_line"] + 1
        content = F.array_join(F.slice(text_lines, section["start_line"], size), "\n")
        return F.struct(section["section_no"].alias("section_no"),
                        (preview(content, limit) if limit else content).alias("content"))

    found = _with_lines(lambda text_lines, sections_: F.transform(sections_, lambda s: cut(text_lines, s)))
    return unnest(docs, ["doc_id"], found, "s").select("doc_id", "s.*")


def doc_stats(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(
        "doc_id", F.size(lines(text)).cast("long").alias("total_lines"), word_count(text).alias("total_words"),
        F.length(text).cast("long").alias("total_characters"))


def outline_summary(docs: DataFrame) -> DataFrame:
    """Section counts beside the document statistics; documents without sections count 0."""
    def counts(sections_: Column) -> Column:
        annexes_ = F.size(F.filter(sections_, lambda s: s["type"] == "annex")).cast("long")
        total = F.size(sections_).cast("long")
        return F.struct(total.alias("total_sections"), annexes_.alias("annexes"), (total - annexes_).alias("main_sections"))

    none = F.struct(*[F.lit(0).cast("long").alias(name) for name in ("total_sections", "annexes", "main_sections")])
    found = F.coalesce(_with_lines(lambda _, sections_: F.when(sections_.isNotNull(), counts(sections_))), none)
    text = F.col("text")
    return docs.select(
        "doc_id", F.size(lines(text)).cast("long").alias("total_lines"), word_count(text).alias("total_words"),
        F.length(text).cast("long").alias("total_characters"), found.alias("_found")).select(
        "doc_id", "total_lines", "total_words", "total_characters", "_found.*")


def main_sections(found: DataFrame) -> DataFrame:
    return found.filter(F.col("type") != "annex")


def annexes(found: DataFrame) -> DataFrame:
    return found.filter(F.col("type") == "annex")


def toc(docs: DataFrame) -> DataFrame:
    """Table of contents text per document, in document order; the banner alone without sections."""
    def entry(s: Column) -> Column:
        return F.concat(F.repeat(F.lit("  "), s["level"] - 1), s["title"], F.lit(" (Line "),
                        s["start_line"].cast("string"), F.lit(")\n"))

    entries = _with_lines(lambda _, sections_: F.array_join(F.transform(sections_, entry), ""))
    return docs.select("doc_id", F.concat(F.lit(P.TOC_BANNER), F.coalesce(entries, F.lit(""))).alias("toc"))


def toggled(numbers: Column) -> Column:
    """Sections switched on after all toggles: those that an array of section numbers holds an odd number of times."""
    return let(numbers, lambda all_: F.filter(
        F.array_distinct(all_), lambda n: F.size(F.filter(all_, lambda other: other == n)) % 2 == 1))


def exclude_sections(docs: DataFrame, annexes: bool = False, ids: Column | None = None) -> DataFrame:
    """Document text without the lines of excluded sections.

    ``annexes`` leaves out every annex; ``ids``, an array of section numbers in the document row, single sections, which
    annexes are not. Sections that start later end no earlier, so what is kept lies between the end of an excluded one and
    the start of the next: a few ranges of lines, not a list of line numbers. NULL texts have no lines and stay NULL.
    """
    chosen = F.coalesce(F.array().cast("array<bigint>") if ids is None else ids, F.array().cast("array<bigint>"))

    def filtered(text_lines: Column, sections_: Column, numbers: Column) -> Column:
        def is_annex(s: Column) -> Column:
            return s["type"] == "annex"

        gone = F.filter(sections_, lambda s: F.when(is_annex(s), F.lit(annexes)).otherwise(
            F.array_contains(numbers, s["section_no"])))

        def result(out: Column) -> Column:
            starts = F.array_append(F.transform(out, lambda s: s["start_line"]), F.size(text_lines) + 1)
            ends = F.array_prepend(F.transform(out, lambda s: s["end_line"]), F.lit(0))
            spans = F.transform(F.arrays_zip(ends.alias("end"), starts.alias("start")), lambda z: F.struct(
                (z["end"] + 1).alias("first"), (z["start"] - z["end"] - 1).alias("size")))
            return let(F.filter(spans, lambda span: span["size"] > 0), lambda kept: F.struct(
                F.size(F.filter(out, is_annex)).alias("excluded_annexes"),
                F.size(F.filter(out, lambda s: ~is_annex(s))).alias("excluded_sections"),
                F.aggregate(kept, F.lit(0).cast("long"), lambda n, span: n + span["size"]).alias("kept_lines"),
                F.array_join(F.transform(kept, lambda span: F.array_join(
                    F.slice(text_lines, span["first"], span["size"]), "\n")), "\n").alias("text"),
                F.size(text_lines).cast("long").alias("total_lines")))

        return let(gone, result)

    found = let(chosen, lambda numbers: _with_lines(lambda text_lines, sections_: filtered(text_lines, sections_, numbers)))
    return docs.select("doc_id", found.alias("_found")).select("doc_id", "_found.*")


def filtered_files(filtered: DataFrame, name: Column) -> DataFrame:
    """Filtered documents with the descriptive file name of each."""
    return filtered.withColumn(
        "file_name", filtered_name(name, F.col("excluded_annexes"), F.col("excluded_sections")))
