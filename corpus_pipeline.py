"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontamination, near_documents, packing, pii, quality_classifier
from pagewright.llm.shared import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier does not reject.

    Verdicts are kept by row and not by doc_id alone, so repeated ids with other texts have their own.
    """
    columns = docs.columns
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text", "source", "lang"))
    rows = stored(quality_classifier.evidence_rows(keyed, "__key"), "evidence")
    judged = quality_classifier.classify(rows, table(spark, sf_dir, "labels"))
    rejected = judged.where("NOT kept").select("__key").distinct()
    return keyed.join(rejected, "__key", "left_anti").select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_documents.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data generalised, disclosing terms removed."""
    return pii.sanitised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
    ("sanitise", sanitise), ("pack", pack)]

#: Token ids, SimHash trees and window fingerprints cannot be said in SQL; tests hold the run against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet to the shared folder and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
