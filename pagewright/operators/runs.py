"""Bookkeeping of processing runs: step timers, tasks, progress and workflow state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.formats import duration_clock, duration_words, epoch_ms, expected_minutes, percent, round_half_up
from .slices import ROWS, SLICE, across, cuts, passed, sliced, summaries, with_summary, within


# ------------------------------------------------------------------ step timers
def step_durations(events: DataFrame, rows: int = ROWS) -> DataFrame:
    """Timed occurrences of steps from ``run_id, event_id, ts, step_id, action`` (start / stop).

    A start closes whatever step is active. A stop sets the end of the latest occurrence of its
    step, the last stop winning. An occurrence is identified by the event that started it.

    A run may be of any length and density: both looks along it (the start that follows, the start
    a stop belongs to) are taken within time slices of about ``rows`` events, and carried over
    slices by summary rows. The rows themselves are shuffled by (run, slice) once, and once more to
    meet their start.
    """
    at = F.struct("at_ms", "event_id")
    start = F.when(F.col("action") == "start", at)
    narrow = events.select("run_id", "event_id", "step_id", "action", epoch_ms(F.col("ts")).alias("at_ms"))
    parted = sliced(narrow, F.col("at_ms"), cuts(narrow, F.col("at_ms"), rows))

    per_step = summaries(parted, ["run_id", "step_id"], F.min(start).alias("_first"), F.max(start).alias("_last"))
    earlier = passed(across(["run_id", "step_id"]))
    later = passed(across(["run_id"], F.desc(SLICE)))
    # Per run and slice: the last start of each step before it, and the first start of any step behind it.
    carried = (per_step.withColumn("_before", F.max("_last").over(earlier))
               .groupBy("run_id", SLICE).agg(
                   F.min("_first").alias("_first"),
                   F.map_from_entries(F.collect_list(F.struct("step_id", "_before"))).alias("_before"))
               .withColumn("_behind", F.min("_first").over(later)).drop("_first"))

    following = passed(within(["run_id"], [F.desc("at_ms"), F.desc("event_id")]))
    so_far = within(["run_id", "step_id"], ["at_ms", "event_id"]).rowsBetween(Window.unboundedPreceding, 0)
    owned = (with_summary(parted, carried, ["run_id"])
             .withColumn("_next", F.coalesce(F.last(start, ignorenulls=True).over(following), F.col("_behind")))
             .withColumn("_own", F.coalesce(F.last(start, ignorenulls=True).over(so_far),
                                            F.try_element_at("_before", F.col("step_id"))))
             .filter(F.col("_own").isNotNull()))
    stop = F.col("action") != "start"
    end = F.coalesce(F.max(F.when(stop, F.col("at_ms"))), F.max(F.when(~stop, F.col("_next.at_ms"))))
    return (owned.groupBy("run_id", "step_id", "_own").agg(end.alias("end_ms"))
            .select("run_id", "step_id", F.col("_own.event_id").alias("event_id"),
                    F.col("_own.at_ms").alias("start_ms"), "end_ms",
                    (F.col("end_ms") - F.col("_own.at_ms")).alias("duration_ms")))


def step_averages(durations: DataFrame) -> DataFrame:
    """Mean duration of finished occurrences per step over the whole history."""
    finished = durations.filter(F.col("duration_ms") > 0)
    return finished.groupBy("step_id").agg(
        F.count(F.lit(1)).alias("finished"), F.sum("duration_ms").alias("total_ms"),
        round_half_up(F.avg("duration_ms"), 3).alias("average_ms"))


def step_eta(durations: DataFrame, progress: DataFrame, as_of_ms: Column, total_steps: int = 4) -> DataFrame:
    """Estimated time left per run, from its latest occurrence of each step.

    ``progress(run_id, event_id, progress_pct)`` gives the progress of occurrences by their starting event.
    """
    at = F.struct("start_ms", "event_id")
    timers = durations.groupBy("run_id", "step_id").agg(F.max_by(
        F.struct("start_ms", "end_ms", "duration_ms", "event_id"), at).alias("t")).select(
        "run_id", "step_id", "t.*")
    finished = F.col("end_ms").isNotNull() & (F.col("duration_ms") > 0)
    runs = timers.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("known_steps"),
        F.avg(F.when(finished, F.col("duration_ms"))).alias("_mean"),
        F.max_by(F.struct("step_id", "event_id", "start_ms"),
                 F.when(F.col("end_ms").isNull(), at)).alias("active"))
    joined = runs.select(
        "run_id", "known_steps", "_mean", F.col("active.step_id").alias("step_id"),
        F.col("active.event_id").alias("event_id"), F.col("active.start_ms").alias("start_ms")
    ).join(progress, ["run_id", "event_id"], "left")
    elapsed = (as_of_ms - F.col("start_ms")).cast("double")
    total = elapsed / F.nullif(F.col("progress_pct") / 100, F.lit(0.0))
    left = (total - elapsed) + (total_steps - F.col("known_steps")) * F.coalesce("_mean", total)
    return joined.select(
        "run_id", F.col("step_id").alias("active_step"), "known_steps",
        F.when(left.isNull(), P.CALCULATING_PT).otherwise(duration_clock(F.greatest(left, F.lit(0.0)))).alias("eta"))


# ------------------------------------------------------------------ tasks
def task_status(steps: DataFrame) -> DataFrame:
    """Latest state per task; the first terminal state is final."""
    at = F.struct("ts", "event_id")
    terminal = F.col("status").isin(P.TERMINAL_STATES)
    first_end = F.min_by("status", F.when(terminal, at))
    ended = F.min(F.when(terminal, at))
    return steps.groupBy("task_id").agg(
        F.coalesce(first_end, F.max_by("status", at)).alias("status"),
        F.coalesce(F.min_by("event_id", F.when(terminal, at)), F.max_by("event_id", at)).alias("last_event_id"),
        F.count(F.lit(1)).alias("n_steps"), ended.isNotNull().alias("is_final"))


def task_lookup(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Answer to ``request(task_id)``: unknown, not ready, or the result once completed."""
    return requests.join(tasks, "task_id", "left").select(
        "task_id", F.when(F.col("status").isNull(), "Task not found")
        .when(F.col("status") != "completed", "Task not completed yet").otherwise("result").alias("answer"), "status")


# ------------------------------------------------------------------ progress
def progress(runs: DataFrame, as_of_ms: Column, *further: Column) -> DataFrame:
    """Percentage, speed and remaining time of ``run_id, done, total, start_ms``, and further columns."""
    done, total = F.col("done"), F.col("total")
    elapsed = as_of_ms - F.col("start_ms")
    known = (done > 0) & (elapsed > 1000)
    speed = done / F.nullif(elapsed / 1000, F.lit(0.0))
    return runs.select(
        "run_id", percent(done, total).alias("percentage"),
        F.when(known, round_half_up(speed, 2)).otherwise(0.0).alias("speed"),
        F.when(known, duration_words((total - done) / F.nullif(speed, F.lit(0.0)) * 1000))
        .otherwise(P.CALCULATING).alias("eta"),
        duration_words(elapsed).alias("elapsed"), expected_minutes(total).alias("expected_minutes"),
        *further)


def blended_progress(done: Column, total: Column, open_pages: Column, is_reformatting: Column) -> Column:
    """Overall percentage: extraction fills 80, analysis stands at 85, formatting at 95."""
    return (F.when(is_reformatting, F.lit(95.0)).when(total == 0, F.lit(0.0))
            .when((open_pages == 0) & (done == total), F.lit(85.0))
            .otherwise(done / F.nullif(total, F.lit(0)) * 80))


def workflow_step(has_text: Column, is_completed: Column, is_reformatting: Column, is_correcting: Column,
                  is_processing: Column, has_file: Column) -> Column:
    return (F.when(has_text & is_completed, 5).when(is_reformatting, 4).when(is_correcting, 3)
            .when(is_processing, 2).when(has_file, 1).otherwise(0))
