"""Passages that repeat across documents: digests of lines, sentences and pieces of long ones; the earliest stays."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import by_slice, let, stored, table

#: A unit: a line, cut after sentence ends, so that a passage inside a longer line is seen.
UNIT = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"\S+")
#: Sentences of more words than this are cut on, after words whose own hash says so: one in CUT_EVERY. The cuts depend on
#: the words alone, so a passage inside two different sentences falls into the same pieces, but for its two ends.
LONG_SENTENCE, CUT_EVERY = 40, 12
#: Words that repeated units in a row must have together before they are removed.
LEAST_WORDS = 10


def ends_piece(word: str) -> bool:
    return xxhash.xxh3_64_intdigest(word) % CUT_EVERY == 0


def pieces(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, stop, normalised words) of the units of a text that have a word, in order."""
    for m in UNIT.finditer(text):
        words = m[0].lower().rstrip(".!?").split()
        if len(words) <= LONG_SENTENCE:
            if words:
                yield m.start(), m.end(), words
            continue
        # Lower case may change lengths, so places come from the text itself.
        start, held = m.start(), []
        for w in WORD.finditer(text, m.start(), m.end()):
            word = w[0].lower().rstrip(".!?") if w.end() == m.end() else w[0].lower()
            if word:
                held.append(word)
            if held and w.end() < m.end() and ends_piece(word):
                yield start, w.end(), held
                start, held = w.end(), []
        if held:
            yield start, m.end(), held


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, unit, start, stop, words, d1, d2): units of each whole text with offsets and a 128-bit digest.

    Normalised: lower case, single spaces, no sentence end. NULL and empty texts have none. text_key is the XXH64 of the
    text: rows with one doc_id and different texts are documents of their own.
    """
    names = ("doc_id", "text_key", "unit", "start", "stop", "words", "d1", "d2")

    def work(batch: pa.RecordBatch) -> dict:
        out = defaultdict(list)
        for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k, (start, stop, words) in enumerate(pieces(text or "")):
                d = xxhash.xxh3_128_digest(" ".join(words))
                for name, value in zip(names, (doc_id, key, k, start, stop, len(words), int.from_bytes(
                        d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)), strict=True):
                    out[name].append(value)
        return {n: out[n] for n in names}

    return by_slice(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text"), work,
                    "doc_id long, text_key long, unit int, start int, stop int, words int, d1 long, d2 long")


def repeats(found: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_key, start, stop, n_units, n_words, first_doc_id): passages to remove from each document.

    Units are grouped by digest over all documents; the occurrence of the smallest (doc_id, text_key, unit) stays, a NULL
    doc_id ranks first. Rows with equal doc_id and text are one document. Repeated units in a row join to a passage, which
    counts from `least_words` words on. first_doc_id is the smallest document that keeps one of its units. A digest that
    most documents have is one row per task before the shuffle, and its units meet it in a join that Spark splits.
    """
    place = ("doc_id", "text_key", "unit")
    earliest = found.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("kept"))
    # Written, so that the join below has two shuffled sides and Spark can split a digest that many units share.
    twice = stored(earliest.where("n > 1").select("d1", "d2", "kept"), "repeated")
    again = found.join(twice, ["d1", "d2"]).where(~F.struct(*place).eqNullSafe(F.col("kept"))).select(
        *place, "start", "stop", "words", F.col("kept.doc_id").alias("first_doc_id")).distinct()
    run = F.col("unit") - F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("unit"))
    return again.withColumn("run", run).groupBy("doc_id", "text_key", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").cast("int").alias("n_units"),
        F.sum("words").cast("int").alias("n_words"), F.min("first_doc_id").alias("first_doc_id")).where(
        F.col("n_words") >= least_words).drop("run")


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with `removed`, the (start, stop) in the original text, and those passages gone from `text`.

    A column of that name in docs is replaced. Other columns may have any names: the row travels as one column.
    """
    spans = repeats(stored(units(docs), "units"), least_words).groupBy(
        F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text")).agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("removed"))
    columns = [c for c in docs.columns if c != "removed"]
    rows = docs.select(F.struct(*columns).alias("row"), "text", F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64("text").alias("key"))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("of_doc")) & (F.col("key") == F.col("of_text")), "left")
    ends = F.concat(F.array(F.lit(0)), F.col("removed.stop"))
    kept = let(ends, lambda e: F.array_join(F.transform(e, lambda stop, i: F.substring(
        F.col("text"), stop + 1, F.coalesce(F.get(F.col("removed.start"), i), F.length("text")) - stop)), ""))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)
    return joined.select(*((text if c == "text" else F.col("row")[c]).alias(c) for c in columns), "removed")


def op8_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that an earlier document or place has already, with offsets in the original text."""
    return repeats(stored(units(table(spark, sf_dir, "documents")), "units")).drop("text_key")
