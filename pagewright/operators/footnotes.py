"""Footnote markup: references, definitions, renumbering and number-line clean-up.

A document is one row, so text in, text out needs no shuffle. The row forms
(`footnote_refs`, `footnote_defs`, `footnote_entries`) serve joins and reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import before, py_strip, universal_lines
from .rows import unnest


def _number(digits: Column) -> Column:
    """Footnote id without leading zeros, so that 07 and 7 are one."""
    bare = F.ltrim(digits, F.lit("0"))
    return F.when(bare == "", F.lit("0")).otherwise(bare)


def _definitions(text: Column) -> Column:
    """``array<struct<id, body>>`` in document order."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(P.NOTE_DEFINITION), F.lit(0)),
        lambda block: F.struct(
            _number(F.regexp_extract(block, P.NOTE_DEFINITION, 1)).alias("id"),
            py_strip(F.regexp_extract(block, P.NOTE_DEFINITION, 2)).alias("body")))


def _reference_ids(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit(P.NOTE_REFERENCE), F.lit(1)), _number)


def without_definitions(text: Column) -> Column:
    return F.regexp_replace(text, P.NOTE_DEFINITION, "")


def footnote_defs(docs: DataFrame) -> DataFrame:
    return (unnest(docs, ["doc_id"], _definitions(F.col("text")), "d", "pos")
            .select("doc_id", "pos", F.col("d.id").alias("orig_id"), F.col("d.body").alias("body")))


def footnote_refs(docs: DataFrame) -> DataFrame:
    """References outside definitions with their running number from 1."""
    return (unnest(docs, ["doc_id"], _reference_ids(without_definitions(F.col("text"))), "orig_id", "pos")
            .withColumn("footnote_no", F.col("pos") + 1))


def footnote_entries(docs: DataFrame) -> DataFrame:
    """One row per reference that has a definition; the first definition of an id counts."""
    first = footnote_defs(docs).groupBy("doc_id", "orig_id").agg(F.min_by("body", "pos").alias("body"))
    return footnote_refs(docs).join(first, ["doc_id", "orig_id"]).select("doc_id", "footnote_no", "orig_id", "body")


def renumber_footnotes(docs: DataFrame, strip_closing: bool = False) -> DataFrame:
    """References become 1..n in reading order and the definitions move to a closing section."""
    # Sorting by (id, position) puts the first definition of an id ahead of its repeats.
    sorted_defs = F.array_sort(F.transform("_defs", lambda d, i: F.struct(
        d["id"].alias("id"), i.alias("pos"), d["body"].alias("body"))))
    first_defs = F.transform(
        F.filter(F.arrays_zip("_sorted", before("_sorted").alias("previous")),
                 lambda z: F.coalesce(z["previous"]["id"] != z["_sorted"]["id"], F.lit(True))),
        lambda z: z["_sorted"])
    body = F.array_join(F.transform(
        F.split("_main", P.NOTE_REFERENCE, -1),
        lambda piece, i: F.when(i == 0, piece).otherwise(F.concat(i.cast("string"), piece))), "")
    # The size test is a second use of the map, which keeps the optimizer from inlining it into the lambda.
    entries = F.when(F.size("_bodies") > 0, F.array_join(F.transform("_refs", lambda ref, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), F.try_element_at("_bodies", ref), F.lit("\n"))), ""))
    out = (docs.withColumn("_defs", _definitions(F.col("text")))
           .withColumn("_main", without_definitions(F.col("text")))
           .withColumn("_sorted", sorted_defs)
           .withColumn("_first", first_defs)
           .withColumn("_refs", _reference_ids(F.col("_main")))
           .withColumn("_bodies", F.map_from_arrays(
               F.transform("_first", lambda d: d["id"]), F.transform("_first", lambda d: d["body"])))
           .withColumn("text", F.concat(body, F.when(
               F.size("_defs") > 0, F.concat(F.lit(P.NOTE_SECTION_TITLE), entries)).otherwise(F.lit(""))))
           .drop("_defs", "_main", "_sorted", "_first", "_refs", "_bodies"))
    if strip_closing:
        out = out.withColumn("text", F.regexp_replace("text", P.NOTE_REFERENCE_CLOSE, ""))
    return out


def drop_number_lines(docs: DataFrame) -> DataFrame:
    """Remove lines that hold nothing but digits, such as page numbers."""
    kept = F.filter(universal_lines(F.col("text")), lambda line: ~F.rlike(line, F.lit(P.STANDALONE_NUMBER)))
    return docs.withColumn("text", F.array_join(kept, "\n"))
