"""Views and streams over log, task, page and click feeds.

Counts, metrics, task states, page progress and sessions are running views: each batch is merged into a compact state
table (:mod:`.running`), so no row is late or lost and the answer does not depend on the batches. Throttled clicks and
status feeds, which answer row by row and in order, are stateful streams (:mod:`.stateful`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..session import run_folder
from .running import View, aggregated

#: Buckets that sessions are built from; shorter than any gap between sessions.
BUCKET = "1 minute"


def read_feed(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream, with ``ts`` as an event time."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process all that is available into a new table in the shared folder and read it."""
    spark = stream.sparkSession
    folder = run_folder(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def _start(width: str) -> Column:
    return F.window("ts", width)["start"].cast("timestamp_ntz")


def log_count_windows(width: str = "2 seconds") -> View:
    """Entries per level and window, of logs."""
    return aggregated({"window_start": _start(width), "level": F.col("level")}, total=(F.count(F.lit(1)), F.sum))


def metric_windows(width: str = "30 seconds") -> View:
    """Samples, mean and peak of ``value`` per window."""
    def finish(state: DataFrame) -> DataFrame:
        return state.select("window_start", "samples", (F.col("sum_value") / F.col("known")).alias("mean_value"), "peak_value")

    return aggregated({"window_start": _start(width)}, finish, samples=(F.count(F.lit(1)), F.sum),
                      known=(F.count("value"), F.sum), sum_value=(F.sum("value"), F.sum), peak_value=(F.max("value"), F.max))


def page_progress() -> View:
    """Finished and seen pages per document, from ``doc_id, is_done``."""
    return aggregated({"doc_id": F.col("doc_id")}, done=(F.count_if("is_done"), F.sum), seen=(F.count(F.lit(1)), F.sum))


def task_states() -> View:
    """State per task now, from its steps; the first terminal state is final."""
    step = F.struct("ts", "event_id", "status")
    ended = F.when(F.col("status").isin(P.TERMINAL_STATES), step)

    def finish(state: DataFrame) -> DataFrame:
        return state.select("task_id", F.coalesce("first_end.status", "latest.status").alias("status"))

    return aggregated({"task_id": F.col("task_id")}, finish, first_end=(F.min(ended), F.min), latest=(F.max(step), F.max))


def finished_once() -> View:
    """Every finished task a single time, with its first terminal step."""
    step = F.struct("ts", "event_id", "status")
    view = aggregated({"task_id": F.col("task_id")}, first_end=(F.min(step), F.min))
    return View(lambda steps: view.partial(steps.filter(F.col("status").isin(P.TERMINAL_STATES))), view.merge)


def status_lines(steps: DataFrame) -> DataFrame:
    """Steps as event-stream text, one ``data:`` record each, as they come."""
    body = F.to_json(F.struct("task_id", "status"))
    return steps.select(F.concat(F.lit("data: "), body, F.lit("\n")).alias("value"))


def session_windows(gap: str = "30 minutes") -> View:
    """Sessions per user, with a pause of the gap or more between them: start, events and duration up to the last event.

    Events become buckets before sessions are built, so a user with any share of the rows is spread over tasks, and only
    buckets and sessions are put in order. State rows are sessions; those of two batches merge where they are nearer than the gap.
    """
    def joined(parts: DataFrame) -> DataFrame:
        before = Window.partitionBy("user_id").orderBy("first_ts", "last_ts")
        opens = F.coalesce(F.col("first_ts") >= F.max("last_ts").over(before.rowsBetween(Window.unboundedPreceding, -1))
                           + F.expr(f"INTERVAL {gap}"), F.lit(True))
        number = F.count_if("_opens").over(before.rowsBetween(Window.unboundedPreceding, 0))
        return (parts.withColumn("_opens", opens).withColumn("_session", number).groupBy("user_id", "_session")
                .agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("events").alias("events"))
                .drop("_session"))

    def partial(events: DataFrame) -> DataFrame:
        buckets = events.groupBy("user_id", F.window("ts", BUCKET).alias("_bucket")).agg(
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"))
        return joined(buckets.drop("_bucket"))

    def finish(state: DataFrame) -> DataFrame:
        return state.select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("session_start"), "events",
                            (F.unix_millis("last_ts") - F.unix_millis("first_ts")).alias("duration_ms"))

    return View(partial, joined, finish)
