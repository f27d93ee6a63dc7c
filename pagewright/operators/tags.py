"""Tagged text: ``<h> <li> <p>`` blocks with ``<fn>`` notes inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import ahead, js_trim, strip_structure_tags
from .rows import unnest


def _block_text(block: Column) -> Column:
    return js_trim(F.replace(strip_structure_tags(block), F.lit("\n"), F.lit(" ")))


def blocks(docs: DataFrame) -> DataFrame:
    """One row per block: position, tag and clean text."""
    return (unnest(docs, ["doc_id"], F.regexp_extract_all("text", F.lit(P.TAGGED_BLOCK), F.lit(0)), "block", "pos")
            .select("doc_id", "pos", F.regexp_extract("block", "^<(h|li|p)>", 1).alias("tag"),
                    _block_text(F.col("block")).alias("text")))


def note_contents(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(P.NOTE_TAG), F.lit(1)), js_trim)


def note_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.NOTE_TAG)).cast("long")


def _interleave(pieces: Column, mark) -> Column:
    """Join text pieces with ``mark(k)`` between piece k-1 and piece k."""
    return F.array_join(F.transform(pieces, lambda piece, k: F.when(k == 0, piece).otherwise(
        F.concat(mark(k), piece))), "")


def _original_mark(content: Column, number: Column) -> Column:
    found = F.regexp_extract(content, P.NOTE_ORIGINAL_MARK, 0)
    return F.when(found != "", found).otherwise(F.concat(F.lit("["), number, F.lit("]")))


def format_tagged(docs: DataFrame) -> DataFrame:
    """Final text from tagged text, with numbered reference and definition tags, and the note count."""
    # 1. Notes leave a numbered token behind.
    tokenised = _interleave(F.split("text", P.NOTE_TAG, -1),
                            lambda k: F.concat(F.lit("__FOOTNOTE_REF_"), k.cast("string"), F.lit("__")))
    # 2. Only block content survives.
    body = F.array_join(F.transform(F.regexp_extract_all("_tokens", F.lit(P.TAGGED_BLOCK), F.lit(0)), _block_text),
                        "\n\n")

    # 3. The first token of each existing note becomes a reference tag.
    def reference(k: Column) -> Column:
        digits = F.get("_ids", k - 1)
        # Digits count as they are written: `01` names no note.
        number = digits.try_cast("int")
        content = F.when(number.cast("string") == digits, F.get("_notes", number - 1))
        first = (F.size("_ids") == F.size(F.array_distinct("_ids"))) | (F.array_position("_ids", digits) == k)
        tag = F.concat(F.lit("{{footnotenumber"), digits, F.lit("}}"), _original_mark(content, digits),
                       F.lit("{{-footnotenumber"), digits, F.lit("}}"))
        return F.when(content.isNotNull() & first, tag).otherwise(
            F.concat(F.lit("__FOOTNOTE_REF_"), digits, F.lit("__")))

    definitions = F.array_join(F.transform("_notes", lambda content, i: F.concat(
        F.lit("{{footnote"), (i + 1).cast("string"), F.lit("}}"), content,
        F.lit("{{-footnote"), (i + 1).cast("string"), F.lit("}}"))), "\n")
    return (docs.withColumn("_notes", note_contents(F.col("text")))
            .withColumn("_tokens", tokenised)
            .withColumn("_body", body)
            .withColumn("_ids", F.regexp_extract_all("_body", F.lit(P.NOTE_TOKEN), F.lit(1)))
            .withColumn("text", js_trim(F.concat(
                _interleave(F.split("_body", P.NOTE_TOKEN, -1), reference), F.lit("\n\n"), definitions)))
            .withColumn("footnote_count", F.size("_notes").cast("long"))
            .drop("_notes", "_tokens", "_body", "_ids"))


def clean_note(content: Column) -> Column:
    """Note text without its leading mark. Anchored, so that a first letter of a word stays."""
    return js_trim(F.regexp_replace(content, P.NOTE_LEADING_MARK, ""))


def join_blocks(docs: DataFrame) -> DataFrame:
    """Alternative formatting: list items on lines of their own, paragraphs and headings spaced.

    The separator after a block depends on what directly follows it; text between blocks vanishes
    but still counts as the follower. Notes come out as ``footnotes``, marked and renumbered.
    """
    marked = _interleave(F.split("text", P.NOTE_TAG, -1),
                         lambda k: F.concat(F.lit("{{footnotenumber"), k.cast("string"), F.lit("}}")))
    gaps = F.split("_marked", P.TAGGED_BLOCK_ONE_LINE, -1)
    hits = F.regexp_extract_all("_marked", F.lit(P.TAGGED_BLOCK_ONE_LINE), F.lit(0))
    items = F.filter(F.flatten(F.transform(F.arrays_zip("_gaps", "_hits"), lambda z: F.array(z["_gaps"], z["_hits"]))),
                     lambda item: item != "")

    def written(z: Column) -> Column:
        item, following = z["_items"], z["following"]

        def is_block(tag: str) -> Column:
            return F.startswith(item, F.lit(f"<{tag}>")) & F.endswith(item, F.lit(f"</{tag}>"))

        def inner(tag: str) -> Column:
            return js_trim(F.regexp_replace(item, f"</?{tag}>", ""))

        def followed_by(tag: str) -> Column:
            return F.coalesce(F.startswith(following, F.lit(f"<{tag}>")), F.lit(False))

        return (F.when(is_block("p"), F.concat(inner("p"), F.when(followed_by("p"), "\n\n").otherwise("")))
                .when(is_block("li"), F.concat(inner("li"), F.when(followed_by("li"), "\n").otherwise("")))
                .when(is_block("h"), F.concat(inner("h"), F.lit("\n\n"))).otherwise(F.lit("")))

    notes = F.transform(F.regexp_extract_all("text", F.lit(P.NOTE_TAG), F.lit(1)), lambda content, i: F.concat(
        F.lit("{{footnote"), (i + 1).cast("string"), F.lit("}} "), clean_note(content),
        F.lit(" {{-footnote"), (i + 1).cast("string"), F.lit("}}")))
    return (docs.withColumn("footnotes", notes)
            .withColumn("_marked", marked)
            .withColumn("_gaps", gaps).withColumn("_hits", hits)
            .withColumn("_items", items)
            .withColumn("text", js_trim(strip_structure_tags(F.array_join(
                F.transform(F.arrays_zip("_items", ahead("_items", 1).alias("following")), written), ""))))
            .withColumn("footnote_count", F.size("footnotes").cast("long"))
            .drop("_marked", "_gaps", "_hits", "_items"))
