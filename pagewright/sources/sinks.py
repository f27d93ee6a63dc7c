"""Writers: bundles of texts, snapshots, status lines and clearing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import final_name
from ..streaming.feeds import status_lines
from .versioned import Version, VersionedTable


def write_final_texts(docs: DataFrame, name: Column, table: VersionedTable) -> Version:
    """The texts of documents below their final file names; see :func:`write_texts`."""
    return write_texts(docs.withColumn("file_name", final_name(name)), table)


def write_texts(docs: DataFrame, table: VersionedTable) -> Version:
    """Texts ``doc_id, file_name, text`` in bundles: many documents a file, all of them or none.

    Rows are sorted by name within their file, so the column statistics of Parquet are the index of names. Documents of
    the same name both stay, told apart by ``doc_id``. No shuffle.
    """
    return table.append(docs.select("doc_id", "file_name", "text").sortWithinPartitions("file_name", "doc_id"))


def read_texts(table: VersionedTable, *names: str) -> DataFrame:
    """Bundled texts, all or those of some names; the names reach the scan."""
    texts = table.read()
    return texts.filter(F.col("file_name").isin(*names)) if names else texts


def append_snapshots(sessions: DataFrame, table: VersionedTable) -> Version:
    """Add session snapshots in full, all or none; a caller that wants them small applies ``compact_sessions`` first."""
    return table.append(sessions)


def clear_tables(tables: dict[str, VersionedTable]) -> dict[str, int]:
    """Empty a table per kind (logs, errors) and return the rows each had, and all of them as ``total``.

    Rows that are added while a table is counted are neither counted nor cleared.
    """
    cleared = {kind: table.clear() for kind, table in tables.items()}
    return {**cleared, "total": sum(cleared.values())}


def stream_status_lines(updates: DataFrame, path: str, checkpoint: str):
    """Task updates as newline events; ends when the available input is used up."""
    return (status_lines(updates).writeStream.format("text").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
