"""Legal-text layout: classify lines, merge markers and headings with their text, render.

A document stays one row and its lines one array, so the whole operator is a narrow
stage: no line is shuffled and no document meets another in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import ahead, before, first_token, py_strip
from .rows import unnest

MARKERS = [P.ENUM_MARKER, P.NUM_MARKER, P.NUMBERED_PARA_HEAD]
TEXT_LINES = [P.REGULAR, P.ENDS_COLON]
HEADINGS = [P.HEADING_UPPER, P.HEADING_TITLE]
MAJOR = [*HEADINGS, P.PREAMBLE_HEAD, P.TRANSITIONAL, P.SPLIT_MARKER_PARENT]
TWO_BLANKS = [P.PREAMBLE_HEAD, P.TRANSITIONAL, *HEADINGS, P.FOOTNOTE_BLOCK]


def _hit(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def _one_of(token: Column, words: list[str]) -> Column:
    """Membership in a fixed word list, as one folded constant."""
    return F.array_contains(F.split(F.lit(" ".join(words)), " "), token)


def _is_keyword(token: Column) -> Column:
    return _one_of(token, sorted({*P.UPPER_HEADINGS, *P.TITLE_HEADINGS}))


def _heading(text: Column, token: Column) -> Column:
    """Heading type of a line that starts with a keyword; NULL for an ambiguous word in running text."""
    lone = (F.lower(text) == token) | _hit(text, P.KEY_AND_ID)
    return F.when(_one_of(token, P.AMBIGUOUS_HEADINGS) & ~lone, None).otherwise(
        F.when(_one_of(token, P.UPPER_HEADINGS), P.HEADING_UPPER).otherwise(P.HEADING_TITLE))


def _item_type(text: Column) -> Column:
    return (F.when(_hit(text, P.ENUM_MARK), P.ENUM_MARKER)
            .when(_hit(text, P.NUMBERED_HEAD), P.NUMBERED_PARA_HEAD)
            .when(_hit(text, P.NUMBER_MARK), P.NUM_MARKER)
            .when(_hit(text, P.QUOTED_NOTE), P.FOOTNOTE_BLOCK)
            .when(_hit(text, P.ENUM_ITEM), P.ENUM_LINE)
            .when(_hit(text, P.NUMBERED_ITEM), P.NUMBERED_LINE))


def line_type(text: Column, low: Column, token: Column) -> Column:
    """Type of a stripped line outside the preamble, given its lower case and lower first token."""
    items = F.when(_hit(text, P.MARK_LIKE), _item_type(text))
    rest = F.when(F.endswith(text, F.lit(":")), P.ENDS_COLON).otherwise(P.REGULAR)
    return (F.when(low == P.PREAMBLE_TITLE, P.PREAMBLE_HEAD)
            .when(text.isin(P.PREAMBLE_INTROS), P.PREAMBLE_INTRO)
            .when(low.isin(P.TRANSITIONS), P.TRANSITIONAL)
            .otherwise(F.coalesce(F.when(_is_keyword(token), _heading(text, token)), items, rest)))


def _preamble_clause(text: Column, plain_type: Column) -> Column:
    """Whether the line is a clause if the line before it belongs to the preamble."""
    starts = F.lit(False)
    for starter in P.PREAMBLE_STARTERS:
        starts = starts | F.startswith(text, F.lit(starter + " "))
    opening = (starts & ~_hit(text, P.ENUM_ITEM) & ~_hit(text, P.NUMBERED_ITEM)
               & ~_is_keyword(F.lower(first_token(text))))
    plain = (plain_type == P.REGULAR) & ~_hit(first_token(text), P.NUMERAL)
    return (~plain_type.isin(P.PREAMBLE_HEAD, P.PREAMBLE_INTRO, P.TRANSITIONAL)) & (opening | plain)


def _line(line_no: Column, sub_no: int, text: Column, kind: Column) -> Column:
    return F.struct(line_no.alias("line_no"), F.lit(sub_no).alias("sub_no"), text.alias("text"), kind.alias("type"))


def _retyped(x: Column, text: Column, kind: Column) -> Column:
    return F.struct(x["line_no"].alias("line_no"), x["sub_no"].alias("sub_no"), text.alias("text"), kind.alias("type"))


def _classified(docs: DataFrame) -> DataFrame:
    """Adds ``_rows``: the kept lines with their final type, split lines as two entries."""
    def entries(x: Column) -> Column:
        head, mark, rest = (py_strip(F.regexp_extract(x["text"], P.SPLIT_ITEM, g)) for g in (1, 2, 3))
        kind = line_type(x["text"], x["low"], F.lower(first_token(x["text"])))
        return F.when(_hit(x["text"], P.MARK_LIKE) & _hit(x["text"], P.SPLIT_ITEM), F.array(
            _line(x["line_no"], 0, head, F.lit(P.SPLIT_MARKER_PARENT)),
            _line(x["line_no"], 1, F.concat(mark, F.lit(" "), rest), F.lit(P.ENUM_LINE)))
        ).otherwise(F.array(_line(x["line_no"], 0, x["text"], kind)))

    stripped = F.transform(F.split("text", P.PY_LINE_BREAK, -1), lambda line, i: F.struct(
        i.alias("line_no"), py_strip(line).alias("text")))
    kept = F.filter(stripped, lambda x: (x["text"] != "") & ~_hit(x["text"], P.STANDALONE_NUMBER))
    lowered = F.transform(kept, lambda x: F.struct(
        x["line_no"].alias("line_no"), x["text"].alias("text"), F.lower(x["text"]).alias("low")))
    # What a line does to "inside the preamble": 1 enters, 0 leaves, - keeps. Each deciding line and
    # the keeping lines behind it form one run, which carries the decision forward. Most documents
    # have no line that enters, and for those nothing below is computed.
    enters = F.exists("_lines", lambda x: x["type"].isin(P.PREAMBLE_HEAD, P.PREAMBLE_INTRO))
    clause = F.when(enters, F.transform("_lines", lambda x: _preamble_clause(x["text"], x["type"])))
    effect = F.array_join(F.transform(F.arrays_zip("_lines", "_clause"), lambda z: F.when(
        z["_lines"]["type"].isin(P.PREAMBLE_HEAD, P.PREAMBLE_INTRO), "1").when(z["_clause"], "-").otherwise("0")), "")
    inside = F.flatten(F.transform(
        F.regexp_extract_all(effect, F.lit("^-+|[01]-*"), F.lit(0)),
        lambda run: F.array_repeat(F.startswith(run, F.lit("1")), F.length(run))))
    final = F.transform(F.arrays_zip("_lines", "_clause", before("_inside").alias("inside")), lambda z: _retyped(
        z["_lines"], z["_lines"]["text"],
        F.when(z["_clause"] & F.coalesce(z["inside"], F.lit(False)), P.PREAMBLE_CLAUSE).otherwise(z["_lines"]["type"])))
    return (docs.withColumn("_lines", F.flatten(F.transform(lowered, entries)))
            .withColumn("_clause", clause)
            .withColumn("_inside", F.when(F.col("_clause").isNotNull(), inside))
            .withColumn("_rows", F.when(F.col("_clause").isNotNull(), final).otherwise(F.col("_lines")))
            .drop("_lines", "_clause", "_inside"))


def _merged(docs: DataFrame) -> DataFrame:
    """``_rows`` after the marker merge and, on what is left, the heading merge."""
    def takes_text(x: Column, following: Column) -> Column:
        return F.coalesce(x["type"].isin(MARKERS) & following["type"].isin(TEXT_LINES), F.lit(False))

    def with_marker(z: Column) -> Column:
        x, following = z["_rows"], z["following"]
        joined = _retyped(x, F.concat(x["text"], F.lit(" "), following["text"]),
                          F.when(x["type"] == P.ENUM_MARKER, P.ENUM_LINE).otherwise(P.NUMBERED_LINE))
        return F.when(takes_text(z["previous"], x), None).when(takes_text(x, following), joined).otherwise(x)

    def takes_title(z: Column) -> Column:
        head, title, after = z["_compact"], z["following"], z["second"]
        return F.coalesce(
            head["type"].isin(HEADINGS) & title["type"].isin(TEXT_LINES) & ~after["type"].isin(MAJOR)
            & _hit(head["text"], P.KEY_AND_ID) & ~_hit(title["text"], P.ITEM_START)
            & ~_is_keyword(F.lower(first_token(title["text"]))), F.lit(False))

    def with_title(z: Column) -> Column:
        x = z["_compact"]
        joined = _retyped(x, F.concat(x["text"], F.lit(" "), z["following"]["text"]), x["type"])
        return F.when(z["taken"], None).when(z["takes"], joined).otherwise(x)

    pairs = F.arrays_zip("_rows", before("_rows").alias("previous"), ahead("_rows", 1).alias("following"))
    triples = F.arrays_zip("_compact", ahead("_compact", 1).alias("following"), ahead("_compact", 2).alias("second"))
    decided = F.arrays_zip("_compact", ahead("_compact", 1).alias("following"), F.col("_takes").alias("takes"),
                           before("_takes").alias("taken"))
    return (docs.withColumn("_compact", F.array_compact(F.transform(pairs, with_marker)))
            .withColumn("_takes", F.transform(triples, takes_title))
            .withColumn("_rows", F.array_compact(F.transform(decided, with_title))).drop("_compact", "_takes"))


def _as_rows(docs: DataFrame) -> DataFrame:
    return unnest(docs, ["doc_id"], "_rows", "r").select("doc_id", "r.line_no", "r.sub_no", "r.type", "r.text")


def classify_lines(docs: DataFrame) -> DataFrame:
    """One row per kept line: ``doc_id, line_no, sub_no, type, text``."""
    return _as_rows(_classified(docs))


def merge_lines(docs: DataFrame) -> DataFrame:
    """The typed lines after both merges."""
    return _as_rows(_merged(_classified(docs)))


def align(docs: DataFrame) -> DataFrame:
    """Documents with their text laid out again."""
    def rendered(x: Column) -> Column:
        text = F.when(x["type"].isin(P.PREAMBLE_HEAD, P.HEADING_UPPER), F.upper(x["text"])).otherwise(x["text"])
        blanks = F.when(x["type"].isin(TWO_BLANKS), "\n\n").when(x["type"] == P.NUMBERED_PARA_HEAD, "\n").otherwise("")
        return F.concat(blanks, text)

    return (_merged(_classified(docs))
            .withColumn("text", F.array_join(F.transform("_rows", rendered), "\n")).drop("_rows"))
