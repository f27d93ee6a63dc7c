"""Saved sessions: compaction, reading, matching with files and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.formats import age, epoch_ms, percent
from .rows import unnest

SIZE_LIMIT = 50 * 1024 * 1024
KEEP_LOGS = 100
FILE_KEY = ["name", "size", "last_modified"]
DAY_MS = 24 * 60 * 60 * 1000

STATE_SCHEMA = """processData struct<isProcessing: boolean, isCompleted: boolean,
progress: struct<processed: bigint, total: bigint, phase: string>>,
fileInfo struct<name: string, size: bigint, lastModified: bigint>, timestamp bigint"""


def compact_sessions(sessions: DataFrame, limit: int = SIZE_LIMIT) -> DataFrame:
    """Sessions whose JSON is too large keep their newest logs and lose page images."""
    size = F.length(F.to_json(F.struct(*sessions.columns)))
    logs, results = F.col("debug_logs"), F.col("results")
    newest = F.slice(logs, F.greatest(F.size(logs) - KEEP_LOGS + 1, F.lit(1)), F.lit(KEEP_LOGS))
    blanked = F.transform(results, lambda page: page.withField(
        "image_url", F.when(F.coalesce(page["image_url"], F.lit("")) != "", "compressed")))
    return (sessions.withColumn("_large", size > limit)
            .withColumn("debug_logs", F.when(F.col("_large"), newest).otherwise(logs))
            .withColumn("results", F.when(F.col("_large"), blanked).otherwise(results)).drop("_large"))


def to_state(snapshot_columns: DataFrame) -> DataFrame:
    """Snapshots as saved-state JSON: ``state``."""
    c = F.col
    body = F.struct(
        F.struct(
            c("is_processing").alias("isProcessing"), c("is_completed").alias("isCompleted"),
            F.struct(c("done_pages").alias("processed"), c("total_pages").cast("long").alias("total"),
                     c("phase").alias("phase")).alias("progress")).alias("processData"),
        F.struct(c("name"), c("size"), c("last_modified").alias("lastModified")).alias("fileInfo"),
        c("saved_ms").alias("timestamp"))
    return snapshot_columns.select("event_id", F.to_json(body).alias("state"))


def read_states(states: DataFrame, state: str = "state") -> DataFrame:
    """Saved-state JSON as columns; malformed text reads as no state."""
    # Tested inside an array, so that the text is parsed once and not again for a pushed-down filter.
    parsed = F.filter(F.array(F.from_json(state, STATE_SCHEMA)), lambda s: s["fileInfo"].isNotNull())
    return unnest(states, ["event_id"], parsed, "s").select(
        "event_id", F.col("s.fileInfo.name").alias("name"), F.col("s.fileInfo.size").alias("size"),
        F.col("s.fileInfo.lastModified").alias("last_modified"), F.col("s.timestamp").alias("saved_ms"),
        F.col("s.processData").alias("process"))


def latest_sessions(snapshots: DataFrame, key: list[str] = FILE_KEY) -> DataFrame:
    """Newest snapshot per file, by a mergeable maximum rather than a ranking."""
    rest = [c for c in snapshots.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct("saved_ms", "event_id")).alias("_newest")
    return snapshots.groupBy(*key).agg(newest).select(*key, "_newest.*")


def match_sessions(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Files with the snapshot saved for exactly that name, size and modification time."""
    return files.join(latest_sessions(snapshots), FILE_KEY)


def is_fresh(saved_ms: Column, as_of_ms: Column) -> Column:
    return as_of_ms - saved_ms < DAY_MS


def is_incomplete(process: Column) -> Column:
    return F.coalesce(process.isNotNull() & ~process["isCompleted"] & process["isProcessing"], F.lit(False))


def resume_info(matched: DataFrame, as_of_ms: Column) -> DataFrame:
    """What a resume dialogue shows, with defaults for missing values."""
    step, process = F.col("process.progress"), F.col("process")
    return matched.select(
        *FILE_KEY, F.coalesce("name", F.lit(P.UNKNOWN_FILE)).alias("file_name"),
        F.coalesce(step["processed"], F.lit(0)).alias("done_pages"),
        F.coalesce(F.nullif(step["phase"], F.lit("")), F.lit(P.UNKNOWN_STEP)).alias("last_step"),
        percent(F.coalesce(step["processed"], F.lit(0)), F.coalesce(step["total"], F.lit(0))).alias("completion"),
        is_fresh(F.col("saved_ms"), as_of_ms).alias("is_fresh"), is_incomplete(process).alias("is_incomplete"),
        age(as_of_ms - F.col("saved_ms")).alias("age"))


def session_completion(completed_pages: Column, total_pages: Column) -> Column:
    """Completion from the list of completed pages."""
    return percent(F.size(completed_pages), total_pages)


def session_length(events: DataFrame) -> DataFrame:
    """Time between the first and the last event of each user."""
    at = epoch_ms(F.col("ts"))
    return events.groupBy("user_id").agg((F.max(at) - F.min(at)).alias("duration_ms"))
