"""SQL twins of the queries over events."""

from __future__ import annotations

from ..functions import patterns as P
from .oracle_text import hit, q

AS_OF = "1706659200000"

LOGS = """logs AS (SELECT event_id AS id, ts,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'click' THEN 'debug' ELSE 'info' END AS level,
  CASE WHEN event_id % 11 = 0 THEN 'debug-api' WHEN event_type = 'view' THEN 'middleware' ELSE 'server' END AS source,
  CASE WHEN event_id % 13 = 0 THEN 'GET /api/debug/logs' WHEN event_id % 17 = 0 THEN 'Logs requested'
    WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'network timeout' WHEN event_type = 'error' THEN 'invalid format'
    WHEN event_id % 19 = 0 THEN concat('Phase ', cast(event_id % 4 + 1 AS varchar), ' started')
    ELSE concat('event ', event_type) END AS message FROM events),
lined AS (SELECT *, concat('[', strftime(ts, '%H:%M:%S'), '] ', upper(level), ': ', message) AS line FROM logs),
relevant AS (SELECT * FROM lined WHERE source <> 'debug-api' AND message <> 'Logs requested'
  AND NOT starts_with(message, 'GET /api/debug'))"""

LOG_QUERY = f"""WITH {LOGS} SELECT id, level, source, message, line FROM relevant WHERE level = 'error'
ORDER BY ts DESC, id DESC LIMIT 50"""
LOG_LEVEL_COUNTS = f"WITH {LOGS} SELECT level, count(*) AS total FROM relevant GROUP BY level"
LOG_TOTAL = f"WITH {LOGS} SELECT count(*) AS total FROM relevant WHERE source = 'server'"
RETAINED_LOGS = f"WITH {LOGS} SELECT id, level, message FROM logs ORDER BY ts DESC, id DESC LIMIT 1000"
LOG_LINES = f"WITH {LOGS} SELECT id, line FROM relevant ORDER BY ts DESC, id DESC LIMIT 10"

ERRORS = f"{LOGS}, errors AS (SELECT id, ts, concat('[', source, '] ', message) AS error FROM logs WHERE level = 'error')"
ERROR_SUMMARY = f"""WITH {ERRORS} SELECT error, count(*) AS total,
count(*) FILTER (WHERE {hit('error', P.RECOVERABLE_ERROR)}) AS recoverable,
count(*) FILTER (WHERE {' OR '.join(f"contains(error, {q(w)})" for w in P.RETRIABLE_WORDS)}) AS retriable
FROM errors GROUP BY error"""
RETAINED_ERRORS = f"WITH {ERRORS} SELECT id, error FROM errors ORDER BY ts DESC, id DESC LIMIT 100"
CLIENT_LOGS = f"WITH {LOGS} SELECT id, level, message FROM logs ORDER BY ts DESC, id DESC LIMIT 200"
STATUS_SUMMARY = f"""WITH {ERRORS} SELECT 'logs' AS section, 'total' AS name, count(*) AS total, NULL::BIGINT AS id FROM logs
UNION ALL SELECT 'level', l, (SELECT count(*) FROM logs WHERE level = l), NULL
  FROM (VALUES ('info'), ('warn'), ('error'), ('debug')) v(l)
UNION ALL SELECT 'errors', 'total', count(*), NULL FROM errors
UNION ALL SELECT 'recent', error, NULL, id FROM (SELECT * FROM errors ORDER BY ts DESC, id DESC LIMIT 5)"""
RECENT_ERRORS = f"WITH {ERRORS} SELECT id, error FROM errors ORDER BY ts DESC, id DESC LIMIT 5"


def any_word(words) -> str:
    return "(" + " OR ".join(f"contains(line, {q(w)})" for w in words) + ")"


_SEVERITY = " ".join(f"WHEN {any_word(words)} THEN {q(name)}" for name, words in P.SEVERITY_WORDS)
LOG_SEVERITY = f"""WITH {LOGS} SELECT CASE {_SEVERITY} ELSE 'plain' END AS severity, count(*) AS total,
count(*) FILTER (WHERE {any_word(P.OCR_ISSUE_WORDS)}) AS ocr_issues,
count(*) FILTER (WHERE {any_word(P.DETECTION_WORDS)}) AS detection_problems FROM lined GROUP BY ALL"""

_PHASE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(message, {q(w)})" for w in words) + f" THEN {phase}"
    for phase, words in P.PHASE_WORDS.items()) + " ELSE 0 END"


def states(phase: str) -> str:
    return ", ".join(f"CASE WHEN {phase} > {p} THEN 'completed' WHEN {phase} = {p} THEN 'active' ELSE 'pending' END "
                     f"AS phase_{p}" for p in (1, 2, 3, 4))


PHASE_WINDOW = f"""WITH {LOGS}, named AS (SELECT id, max({_PHASE}) OVER (ORDER BY ts, id
ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS phase FROM logs) SELECT id, phase, {states('phase')} FROM named"""
PHASE_WITH_STATE = f"""WITH {LOGS}, named AS (SELECT id, level, max({_PHASE}) OVER (ORDER BY ts, id
ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS p FROM logs),
told AS (SELECT id, CASE WHEN id % 37 = 0 THEN 4 WHEN level = 'info' AND p = 0 THEN 1 ELSE p END AS phase FROM named)
SELECT id, phase, {states('phase')} FROM told"""
CURRENT_PHASE = f"""WITH {LOGS} SELECT max({_PHASE}) AS phase FROM (SELECT * FROM logs ORDER BY ts DESC, id DESC LIMIT 10)"""

STEPS = """steps AS (SELECT user_id AS run_id, event_id, (epoch_us(ts) // 1000) AS at_ms, concat('phase', event_id % 4 + 1) AS step_id,
  event_type = 'signup' AS is_stop FROM events),
starts AS (SELECT *, lead(at_ms) OVER (PARTITION BY run_id ORDER BY at_ms, event_id) AS next_any,
  row_number() OVER (PARTITION BY run_id, step_id ORDER BY at_ms, event_id) AS occurrence,
  lead((at_ms, event_id)) OVER (PARTITION BY run_id, step_id ORDER BY at_ms, event_id) AS next_same
  FROM steps WHERE NOT is_stop),
durations AS (SELECT s.run_id, s.step_id, occurrence, s.event_id, s.at_ms AS start_ms,
  coalesce((SELECT max(e.at_ms) FROM steps e WHERE e.is_stop AND e.run_id = s.run_id AND e.step_id = s.step_id
    AND (e.at_ms, e.event_id) > (s.at_ms, s.event_id)
    AND (s.next_same IS NULL OR (e.at_ms, e.event_id) < s.next_same)), next_any) AS end_ms FROM starts s)"""
STEP_DURATIONS = f"WITH {STEPS} SELECT * EXCLUDE (occurrence), end_ms - start_ms AS duration_ms FROM durations"
STEP_AVERAGES = f"""WITH {STEPS} SELECT step_id, count(*) AS finished, sum(end_ms - start_ms)::BIGINT AS total_ms,
floor(avg(end_ms - start_ms) * 1000 + 0.5) / 1000 AS average_ms FROM durations WHERE end_ms > start_ms GROUP BY step_id"""


def clock(ms: str) -> str:
    s = f"(floor({ms} / 1000)::BIGINT)"
    return (f"CASE WHEN {ms} < 1000 THEN concat(floor({ms} + 0.5)::BIGINT, 'ms') WHEN {s} >= 3600 THEN concat({s} // 3600, ':', "
            f"lpad(({s} // 60 % 60)::VARCHAR, 2, '0'), ':', lpad(({s} % 60)::VARCHAR, 2, '0')) WHEN {s} >= 60 THEN "
            f"concat({s} // 60, ':', lpad(({s} % 60)::VARCHAR, 2, '0')) ELSE concat({s}, 's') END")


def in_words(ms: str) -> str:
    s = f"(floor({ms} / 1000)::BIGINT)"
    return (f"CASE WHEN {s} >= 3600 THEN concat({s} // 3600, 'h ', {s} // 60 % 60, 'm') WHEN {s} >= 60 THEN "
            f"concat({s} // 60, 'm ', {s} % 60, 's') ELSE concat({s}, 's') END")


STEP_ETA = f"""WITH {STEPS}, timers AS (SELECT * FROM durations
  QUALIFY row_number() OVER (PARTITION BY run_id, step_id ORDER BY start_ms DESC, event_id DESC) = 1),
known AS (SELECT run_id, count(*) AS known_steps,
  avg(CASE WHEN end_ms > start_ms THEN end_ms - start_ms END) AS mean FROM timers GROUP BY run_id),
active AS (SELECT run_id, step_id, start_ms, (event_id % 101)::DOUBLE AS pct FROM timers WHERE end_ms IS NULL
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY start_ms DESC, event_id DESC) = 1),
est AS (SELECT k.run_id, step_id, known_steps, mean, ({AS_OF} - start_ms)::DOUBLE AS elapsed,
  ({AS_OF} - start_ms)::DOUBLE / nullif(pct / 100, 0) AS total FROM known k LEFT JOIN active a USING (run_id)),
remaining AS (SELECT *, greatest((total - elapsed) + (4 - known_steps) * coalesce(mean, total), 0) AS r FROM est)
SELECT run_id, step_id AS active_step, known_steps,
CASE WHEN total IS NULL THEN 'Calculando...' ELSE {clock('r')} END AS eta FROM remaining"""

PROGRESS_ETA = f"""WITH u AS (SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'view') AS done, count(*) AS total,
  count(*) FILTER (WHERE event_type = 'error') AS open_pages, {AS_OF} - min((epoch_us(ts) // 1000)) AS elapsed FROM events GROUP BY user_id),
v AS (SELECT *, done / (elapsed / 1000) AS speed FROM u)
SELECT run_id, floor(done / total * 100 + 0.5)::BIGINT AS percentage,
CASE WHEN done > 0 AND elapsed > 1000 THEN floor(speed * 100 + 0.5) / 100 ELSE 0.0::DOUBLE END AS speed,
CASE WHEN done > 0 AND elapsed > 1000 THEN {in_words('((total - done) / speed * 1000)')} ELSE 'Calculating...' END AS eta,
{in_words('elapsed')} AS elapsed, ceil(total / 20)::BIGINT AS expected_minutes,
floor(CASE WHEN run_id % 9 = 0 THEN 95 WHEN open_pages = 0 AND done = total THEN 85 ELSE done / total * 80 END + 0.5)::BIGINT
AS blended FROM v"""

TASKS = """steps AS (SELECT user_id AS task_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'completed'
  WHEN 'error' THEN 'failed' ELSE 'started' END AS status FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY status = 'started',
  CASE WHEN status <> 'started' THEN ts END ASC NULLS LAST, CASE WHEN status <> 'started' THEN event_id END ASC NULLS LAST,
  ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY task_id) AS n_steps FROM steps),
tasks AS (SELECT task_id, status, event_id AS last_event_id, n_steps, status <> 'started' AS is_final FROM ranked WHERE r = 1)"""
TASK_STATUS = f"WITH {TASKS} SELECT * FROM tasks"
TASK_LOOKUP = f"""WITH {TASKS} SELECT doc_id AS task_id, CASE WHEN status IS NULL THEN 'Task not found'
WHEN status <> 'completed' THEN 'Task not completed yet' ELSE 'result' END AS answer, status
FROM documents LEFT JOIN tasks ON task_id = doc_id"""

SESSION_RESUME = f"""WITH snaps AS (SELECT user_id, concat('file', user_id, '.pdf') AS name, user_id * 1000 AS size, user_id AS last_modified,
  (epoch_us(ts) // 1000) AS saved_ms, event_id, event_type = 'purchase' AS done, event_id % 101 AS pages FROM events WHERE event_id % 23 <> 0),
latest AS (SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY saved_ms DESC, event_id DESC) = 1),
files AS (SELECT DISTINCT user_id, user_id * 1000 + CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS size FROM events),
m AS (SELECT l.*, ({AS_OF} - saved_ms) // 60000 AS minutes FROM latest l JOIN files f ON f.user_id = l.user_id AND f.size = l.size)
SELECT name, size, last_modified, name AS file_name, pages AS done_pages,
CASE WHEN event_id % 5 > 0 THEN concat('Phase ', event_id % 5) ELSE {q(P.UNKNOWN_STEP)} END AS last_step,
pages AS completion, {AS_OF} - saved_ms < 86400000 AS is_fresh, NOT done AS is_incomplete,
CASE WHEN minutes >= 60 THEN concat('há ', minutes // 60, 'h', minutes % 60, 'min')
  WHEN minutes > 0 THEN concat('há ', minutes, ' minutos') ELSE 'há pouco tempo' END AS age FROM m"""
SESSION_LENGTH = "SELECT user_id, max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000)) AS duration_ms FROM events GROUP BY user_id"

CLICK_THROTTLE = """WITH RECURSIVE clicks AS MATERIALIZED (SELECT user_id, at_ms, min(event_id) AS event_id
  FROM (SELECT user_id, event_id, (epoch_us(ts) // 1000) // 20000 AS at_ms FROM events) GROUP BY user_id, at_ms),
nexts AS MATERIALIZED (SELECT c.user_id, c.at_ms, c.event_id, n.at_ms AS next_at FROM (SELECT *, at_ms + 1000 AS due FROM clicks) c
  ASOF LEFT JOIN clicks n ON n.user_id = c.user_id AND n.at_ms >= c.due),
kept AS (SELECT user_id, at_ms, event_id, next_at FROM nexts
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY at_ms) = 1
  UNION ALL SELECT n.user_id, n.at_ms, n.event_id, n.next_at FROM kept k JOIN nexts n
    ON n.user_id = k.user_id AND n.at_ms = k.next_at)
SELECT user_id, event_id, at_ms FROM kept"""

WORKFLOW_STEP = f"""SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_type = 'purchase' THEN 5 WHEN event_id % 5 = 0 THEN 4
WHEN event_type = 'error' THEN 3 WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 7 > 0 THEN 1 ELSE 0 END AS step,
{states('event_id % 5')} FROM events"""
