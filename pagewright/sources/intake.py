"""Readers: document inventory, page text, posted logs and errors, saved sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fragments_to_text
from ..operators.logs import accept_errors, accept_logs

PAGE_SCHEMA = "doc_id bigint, page_no int, items array<struct<str: string>>"
LOG_SCHEMA = "id bigint, ts timestamp, level string, message string, data string, source string"
ERROR_SCHEMA = "id bigint, ts timestamp, error string, stack string, context string, source string"


def document_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Identity of every PDF below a folder: name, size, time of the last change, path. File contents are not read.

    The name is the last part of the path; ``last_modified`` is in milliseconds since 1970,
    whatever the time zone of the session.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]")
             .option("recursiveFileLookup", "true").load(folder))
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("_metadata.file_size").alias("size"),
        F.unix_millis("_metadata.file_modification_time").alias("last_modified"), "path")


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """Pages from JSON text layers: ``doc_id, page_no, text``."""
    return spark.read.schema(PAGE_SCHEMA).json(path).select(
        "doc_id", "page_no", fragments_to_text(F.coalesce("items", F.array().cast("array<struct<str:string>>")))
        .alias("text"))


def _json(spark: SparkSession, path: str, schema: str, stream: bool) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).json(path)


def posted_logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Accepted log posts, as a table or a stream."""
    return accept_logs(_json(spark, path, LOG_SCHEMA, stream))


def posted_errors(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return accept_errors(_json(spark, path, ERROR_SCHEMA, stream))
