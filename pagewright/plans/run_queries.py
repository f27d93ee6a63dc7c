"""Catalogue entries over events: logs, steps, tasks, sessions and clicks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formats import epoch_ms, log_line
from ..operators import logs, runs, sessions
from ..operators.throttle import throttle
from ..session import table
from . import derived, oracle_runs

#: Evaluation time of everything relative: 2024-01-31 00:00.
AS_OF_MS = 1_706_659_200_000


def as_of():
    return F.lit(AS_OF_MS).cast("long")


def log_query(spark, sf_dir):
    """The 50 newest error entries."""
    return logs.log_query(derived.logs(spark, sf_dir), level="error").select("id", "level", "source", "message", "line")


def log_level_counts(spark, sf_dir):
    return logs.log_counts(logs.without_noise(derived.logs(spark, sf_dir)))


def log_total(spark, sf_dir):
    return logs.log_total(derived.logs(spark, sf_dir), source="server")


def retained_logs(spark, sf_dir):
    """The entries a bounded log keeps."""
    return logs.retain_latest(derived.logs(spark, sf_dir)).select("id", "level", "message")


def client_logs(spark, sf_dir):
    """The entries a client's view keeps."""
    return logs.retain_latest(derived.logs(spark, sf_dir), logs.KEEP_CLIENT).select("id", "level", "message")


def retained_errors(spark, sf_dir):
    """The errors a bounded log keeps."""
    errors = logs.error_entries(derived.logs(spark, sf_dir))
    return logs.retain_latest(errors, logs.KEEP_ERRORS).select("id", "error")


def status_summary(spark, sf_dir):
    entries = derived.logs(spark, sf_dir)
    return logs.status_summary(entries, logs.error_entries(entries))


def log_lines(spark, sf_dir):
    """The ten newest entries as lines."""
    return logs.log_query(derived.logs(spark, sf_dir), limit=10).select("id", "line")


def error_summary(spark, sf_dir):
    return logs.error_summary(logs.error_entries(derived.logs(spark, sf_dir)))


def recent_errors(spark, sf_dir):
    return logs.recent_errors(logs.error_entries(derived.logs(spark, sf_dir)), 5).select("id", "error")


def log_severity(spark, sf_dir):
    entries = derived.logs(spark, sf_dir)
    return logs.severity_counts(entries.select(log_line(F.col("ts"), F.col("level"), F.col("message")).alias("line")))


def phase_window(spark, sf_dir):
    return logs.phase_window(derived.logs(spark, sf_dir))


def phase_with_state(spark, sf_dir):
    """The same where the run is in process (info entries) or formatted (every 37th entry)."""
    entries = derived.logs(spark, sf_dir)
    return logs.phase_window(entries, is_formatting=F.col("id") % 37 == 0, is_processing=F.col("level") == "info")


def current_phase(spark, sf_dir):
    return logs.current_phase(derived.logs(spark, sf_dir))


def _durations(spark, sf_dir):
    return runs.step_durations(derived.step_events(spark, sf_dir))


def step_durations(spark, sf_dir):
    return _durations(spark, sf_dir)


def step_averages(spark, sf_dir):
    return runs.step_averages(_durations(spark, sf_dir))


def step_eta(spark, sf_dir):
    started = derived.step_events(spark, sf_dir).filter(F.col("action") == "start")
    progress = started.select("run_id", "event_id", (F.col("event_id") % 101).cast("double").alias("progress_pct"))
    return runs.step_eta(_durations(spark, sf_dir), progress, as_of())


def progress_eta(spark, sf_dir):
    users = derived.events(spark, sf_dir).groupBy(F.col("user_id").alias("run_id")).agg(
        F.count_if(F.col("event_type") == "view").alias("done"), F.count(F.lit(1)).alias("total"),
        F.min(epoch_ms(F.col("ts"))).alias("start_ms"), F.count_if(F.col("event_type") == "error").alias("open_pages"))
    blended = runs.blended_progress(F.col("done"), F.col("total"), F.col("open_pages"), F.col("run_id") % 9 == 0)
    return runs.progress(users, as_of(), F.floor(blended + 0.5).cast("long").alias("blended"))


def task_status(spark, sf_dir):
    return runs.task_status(derived.task_steps(spark, sf_dir))


def task_lookup(spark, sf_dir):
    """Every document id asked for as a task id; most do not exist."""
    requests = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"))
    return runs.task_lookup(requests, runs.task_status(derived.task_steps(spark, sf_dir)))


def session_resume(spark, sf_dir):
    """Snapshots as JSON (some broken), read back, matched with files (some changed since)."""
    snapshots = derived.session_snapshots(spark, sf_dir)
    states = sessions.to_state(
        snapshots.withColumn("saved_ms", epoch_ms(F.col("ts"))).withColumn(
            "phase", F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("Phase "), (F.col("event_id") % 5).cast("string")))))
    broken = states.withColumn("state", F.when(F.col("event_id") % 23 == 0, F.left("state", F.lit(40)))
                               .otherwise(F.col("state")))
    files = snapshots.select("name", (F.col("size") + F.when(F.col("file_id") % 7 == 0, 1).otherwise(0)).alias("size"),
                             "last_modified").distinct()
    return sessions.resume_info(sessions.match_sessions(files, sessions.read_states(broken)), as_of())


def session_length(spark, sf_dir):
    return sessions.session_length(derived.events(spark, sf_dir))


def click_throttle(spark, sf_dir):
    return throttle(derived.clicks(spark, sf_dir), "user_id")


def workflow_step(spark, sf_dir):
    e, kind = F.col("event_id"), F.col("event_type")
    step = runs.workflow_step(e % 2 == 0, kind == "purchase", e % 5 == 0, kind == "error", e % 3 == 0, e % 7 > 0)
    return derived.events(spark, sf_dir).select("event_id", step.alias("step"), *logs.phase_states(e % 5))


QUERIES = {f.__name__: f for f in (
    log_query, log_level_counts, log_total, retained_logs, client_logs, retained_errors, status_summary, log_lines, error_summary, recent_errors, log_severity,
    phase_window, phase_with_state, current_phase, step_durations, step_averages, step_eta, progress_eta, task_status, task_lookup,
    session_resume, session_length, click_throttle, workflow_step)}
ORACLES = {name: getattr(oracle_runs, name.upper()) for name in QUERIES}
