"""Catalogue entries that run a stream over the events table to its end and read the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formats import round_half_up
from ..streaming import feeds, running, stateful
from . import derived
from .oracle_runs import CLICK_THROTTLE, LOGS, TASKS


def _events(spark, sf_dir):
    return feeds.read_feed(spark, sf_dir, "events.parquet")


def stream_log_counts(spark, sf_dir):
    return running.run(feeds.log_count_windows("1 hour"), derived.as_logs(_events(spark, sf_dir)), "log-counts")


def stream_metrics(spark, sf_dir):
    table = running.run(feeds.metric_windows(), _events(spark, sf_dir), "metrics")
    return table.withColumn("mean_value", round_half_up(F.col("mean_value"), 4))


def stream_progress(spark, sf_dir):
    pages = _events(spark, sf_dir).select(F.col("user_id").alias("doc_id"), (F.col("event_type") == "view").alias("is_done"))
    return running.run(feeds.page_progress(), pages, "progress")


def stream_task_status(spark, sf_dir):
    return running.run(feeds.task_states(), derived.as_task_steps(_events(spark, sf_dir)), "tasks")


def stream_finished_tasks(spark, sf_dir):
    finished = running.run(feeds.finished_once(), derived.as_task_steps(_events(spark, sf_dir)), "finished")
    return finished.select("task_id", F.col("first_end.status").alias("status"), F.col("first_end.event_id").alias("event_id"))


def stream_sessions(spark, sf_dir):
    return running.run(feeds.session_windows(), _events(spark, sf_dir), "sessions")


def stream_throttle(spark, sf_dir):
    """Clicks through the stateful throttle, the feed closed behind them."""
    clicks = derived.as_clicks(_events(stateful.stateful_session(spark), sf_dir))
    feed = stateful.EndedFeed(clicks, "throttle")
    return feed.run(stateful.throttled(feed.stream), spark)


def stream_status_feed(spark, sf_dir):
    """Every fiftieth event subscribes to its user's task, some of them to tasks that do not exist."""
    events = _events(stateful.stateful_session(spark), sf_dir)
    feed = stateful.EndedFeed(stateful.status_feed_rows(derived.as_feed_steps(events), derived.as_subscriptions(events)), "status-feed")
    return feed.run(stateful.status_feeds(feed.stream, keep_ms=100 * stateful.DAY_MS), spark)


QUERIES = {f.__name__: f for f in (
    stream_log_counts, stream_metrics, stream_progress, stream_task_status, stream_finished_tasks, stream_sessions,
    stream_throttle, stream_status_feed)}


def _windowed(width: str, source: str = "events") -> str:
    return f"(SELECT *, time_bucket(INTERVAL '{width}', ts, TIMESTAMP '2000-01-01') AS window_start FROM {source})"


STATUS_FEED = """WITH steps AS (SELECT user_id AS task_id, event_id, epoch_us(ts) // 1000 AS at_ms, concat('step ', event_type) AS message,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'started' END AS status FROM events),
ends AS (SELECT task_id, min((at_ms, event_id)) AS last FROM steps WHERE status <> 'started' GROUP BY 1),
valid AS (SELECT s.*, (s.at_ms, s.event_id) = last AS closing, concat('data: {"status":"', status, '","message":"', message,
    '","timestamp":"', strftime(make_timestamp(at_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g'), 'Z"}', chr(10), chr(10)) AS record
  FROM steps s LEFT JOIN ends USING (task_id) WHERE last IS NULL OR (s.at_ms, s.event_id) <= last),
subs AS (SELECT event_id AS sub_id, user_id + CASE WHEN event_id % 450 = 0 THEN 1000000000 ELSE 0 END AS task_id,
  epoch_us(ts) // 1000 AS since FROM events WHERE event_id % 50 = 0),
met AS (SELECT sub_id, v.*, since, v.at_ms <= since AS early FROM subs JOIN valid v USING (task_id)),
snaps AS (SELECT * FROM met WHERE early QUALIFY row_number() OVER (PARTITION BY sub_id ORDER BY at_ms DESC, event_id DESC) = 1),
updates AS (SELECT m.*, row_number() OVER (PARTITION BY m.sub_id ORDER BY m.at_ms, m.event_id) AS n
  FROM met m SEMI JOIN snaps s ON s.sub_id = m.sub_id WHERE NOT early),
closes AS (SELECT sub_id, task_id, 1 AS n FROM snaps WHERE closing UNION ALL SELECT sub_id, task_id, n + 1 FROM updates WHERE closing)
SELECT task_id, sub_id, 0 AS number, 'snapshot' AS kind, event_id, record FROM snaps
UNION ALL SELECT task_id, sub_id, n, 'update', event_id, record FROM updates
UNION ALL SELECT task_id, sub_id, n, 'close', NULL, concat('event: close', chr(10), 'data: Stream complete', chr(10), chr(10)) FROM closes
UNION ALL SELECT task_id, sub_id, 0, 'missing', NULL, '{"error":"Task not found"}' FROM subs ANTI JOIN snaps USING (sub_id)"""

ORACLES = {
    "stream_log_counts": f"WITH {LOGS} SELECT window_start, level, count(*) AS total FROM {_windowed('1 hour', 'logs')} GROUP BY ALL",
    "stream_metrics": f"""SELECT window_start, count(*) AS samples, floor(avg(value) * 10000 + 0.5) / 10000 AS mean_value,
        max(value) AS peak_value FROM {_windowed('30 seconds')} GROUP BY window_start""",
    "stream_progress": """SELECT user_id AS doc_id, (count(*) FILTER (WHERE event_type = 'view'))::BIGINT AS done,
        count(*) AS seen FROM events GROUP BY user_id""",
    "stream_task_status": f"WITH {TASKS} SELECT task_id, status FROM tasks",
    "stream_finished_tasks": f"WITH {TASKS} SELECT task_id, status, last_event_id AS event_id FROM tasks WHERE is_final",
    "stream_sessions": """WITH gaps AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS opens FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        numbered AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM gaps)
        SELECT user_id, min(ts) AS session_start, count(*) AS events,
        max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) AS duration_ms FROM numbered GROUP BY user_id, s""",
    "stream_throttle": CLICK_THROTTLE,
    "stream_status_feed": STATUS_FEED,
}
