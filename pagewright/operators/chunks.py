"""Fixed-size chunks of text and of page lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slices import SLICE, numbered, fixed

TEXT_CHUNK = 30_000
PAGE_CHUNK = 5


def text_chunks(docs: DataFrame, size: int = TEXT_CHUNK) -> DataFrame:
    """Whole text in pieces of ``size`` characters; a shorter text is one chunk."""
    last = F.greatest(F.ceil(F.length("text") / size).cast("int") - 1, F.lit(0))
    return (docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
            .select("doc_id", "chunk_no",
                    F.substr("text", F.col("chunk_no") * size + 1, F.lit(size)).alias("text")))


def rejoin_chunks(chunks: DataFrame) -> DataFrame:
    """Processed chunks of a document joined by line feeds, as after tagging."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "text")))
    return chunks.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda chunk: chunk["text"]), "\n").alias("text"))


def page_chunks(pages: DataFrame, size: int = PAGE_CHUNK, extraction_every: int = 10,
                correction_every: int = 5) -> DataFrame:
    """Position of each listed page in its document, its chunk, and where progress is saved."""
    at = F.col("item_no")
    return (numbered(fixed(pages, F.col("page_no"), 1_000), ["doc_id"], ["page_no"], "item_no")
            .withColumn("chunk_no", F.floor((at - 1) / size).cast("long"))
            .withColumn("saves_extraction", at % extraction_every == 0)
            .withColumn("saves_correction", at % correction_every == 0).drop(SLICE))
