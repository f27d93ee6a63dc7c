"""Parsing of correction replies and page-number flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import js_trim

_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
#: A whole JSON text that is an array of numbers.
NUMBER_ARRAY = rf"\A[ \t\r\n]*\[[ \t\r\n]*(?:{_NUMBER}[ \t\r\n]*(?:,[ \t\r\n]*{_NUMBER}[ \t\r\n]*)*)?\][ \t\r\n]*\z"


def _first_removed(text: Column, pattern: str) -> Column:
    """``text`` without the first match; later matches stay."""
    return F.regexp_replace(text, rf"(?s)\A(.*?){pattern}", "$1")


def _parse(reply: Column, block: str, done_mark: str, done_note: str, missing_note: str) -> Column:
    found = F.rlike(reply, F.lit(f"(?s){block}"))
    changes = (F.when(found, js_trim(F.regexp_extract(reply, f"(?s){block}", 1)))
               .when(F.contains(reply, F.lit(done_mark)), F.lit(done_note))
               .otherwise(F.lit(missing_note)))
    clean = js_trim(_first_removed(_first_removed(reply, block), done_mark))
    return F.struct(clean.alias("text"), changes.alias("changes"))


def parse_correction(reply: Column) -> Column:
    """Corrected text and change notes of a text-correction reply."""
    return _parse(reply, P.CHANGES_BLOCK, P.CHANGES_NONE, P.NOTE_NO_CHANGES, P.NOTE_CHANGES_MISSING)


def parse_extraction(reply: Column) -> Column:
    """Text and analysis notes of an image-extraction reply."""
    return _parse(reply, P.ANALYSIS_BLOCK, P.ANALYSIS_CLEAN, P.NOTE_CLEAN, P.NOTE_ANALYSIS_MISSING)


def parse_flags(reply: Column) -> Column:
    """Page numbers from a possibly fenced JSON array; NULL unless the whole reply is an array of numbers.

    Numbers that are not whole name no page and are left out.
    """
    bare = F.regexp_replace(F.regexp_replace(reply, r"^```json\n?", ""), r"```\z", "")
    numbers = F.when(F.rlike(bare, F.lit(NUMBER_ARRAY)), F.from_json(bare, "array<double>"))
    whole = F.filter(numbers, lambda n: n == F.floor(n))
    return F.transform(whole, lambda n: n.cast("int"))
