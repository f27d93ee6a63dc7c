"""Running results of streams, as compact state tables that a batch at a time is merged into.

Each batch becomes state rows (counts, extremes: anything mergeable), one per key that it holds. They land as a folder of a
versioned table, whose manifest notes the number of the batch. So a batch that is run again changes nothing, no row is late,
and the result does not depend on how rows are cut into batches or in which order they come. After every few batches the
state rows are merged to one per key: what a reader reads grows with the keys, not with the history.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import run_folder
from ..sources.versioned import Version, VersionedTable

#: Folders of state rows from which on the next batch merges them to one.
MOST_FOLDERS = 8


@dataclass(frozen=True)
class View:
    #: Rows of a batch to state rows.
    partial: Callable[[DataFrame], DataFrame]
    #: State rows of many batches to one per key.
    merge: Callable[[DataFrame], DataFrame]
    #: Merged state rows to what a reader sees.
    finish: Callable[[DataFrame], DataFrame] = lambda state: state


def aggregated(keys: dict[str, Column], finish: Callable[[DataFrame], DataFrame] = lambda state: state,
               **parts: tuple[Column, Callable[[str], Column]]) -> View:
    """A view by keys. Each part has the aggregate of a batch and the one that merges such values, as ``F.sum`` for counts."""
    def partial(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*(column.alias(name) for name, column in keys.items())).agg(
            *(first.alias(name) for name, (first, _) in parts.items()))

    def merge(state: DataFrame) -> DataFrame:
        return state.groupBy(*keys).agg(*(again(name).alias(name) for name, (_, again) in parts.items()))

    return View(partial, merge, finish)


def land(view: View, table: VersionedTable, rows: DataFrame, batch: int, feed: str = "feed") -> Version:
    """Merge a batch of a feed into the table, unless it is there already."""
    seen = table.version()
    if seen.notes.get(feed, -1) >= batch:
        return seen
    state, full = view.partial(rows), len(seen.folders) >= MOST_FOLDERS
    if full:
        state = view.merge(table.read(seen).unionByName(state))
    folder, schema = table.write(state), state.schema.json()

    def added(now: Version) -> Version | None:
        if now.notes.get(feed, -1) >= batch:
            return None
        if full and not set(seen.folders) <= set(now.folders):
            raise RuntimeError(f"{table.path}: cleared while batch {batch} was merged")
        kept = tuple(f for f in now.folders if f not in seen.folders) if full else now.folders
        return replace(now, folders=(*kept, folder), notes={**now.notes, feed: batch}, schema=now.schema or schema)

    return table.switch(added)


def follow(view: View, stream: DataFrame, table: VersionedTable, checkpoint: str, feed: str = "feed",
           **trigger) -> StreamingQuery:
    """Keep the table up to date with a stream; with one checkpoint for each feed of a table."""
    def each(rows: DataFrame, batch: int) -> None:
        land(view, table, rows, batch, feed)

    return (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def now(view: View, table: VersionedTable) -> DataFrame:
    """What a reader sees: of one version, whatever lands meanwhile."""
    return view.finish(view.merge(table.read()))


def run(view: View, stream: DataFrame, name: str) -> DataFrame:
    """Merge all that is available into a new table of the shared folder and read it."""
    folder = run_folder(stream.sparkSession, name)
    table = VersionedTable(stream.sparkSession, f"{folder}/table")
    follow(view, stream, table, f"{folder}/checkpoint").awaitTermination()
    if table.version().schema is None:  # no batch at all: an empty state
        spark = stream.sparkSession
        table.append(view.partial(spark.createDataFrame([], stream.schema)))
    return now(view, table)
