"""Logs, timers, tasks, sessions, slices and the throttle against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import patterns as P
from pagewright.operators import logs, runs, sessions
from pagewright.operators.slices import SLICE, cuts, numbered, sliced
from pagewright.operators.throttle import throttle

T0 = dt.datetime(2024, 1, 1)


def greedy(times, gap=1000):
    kept, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last >= gap:
            kept.append(t)
            last = t
    return kept


def throttled(spark, clicks, **options):
    df = spark.createDataFrame([(u, i, t) for i, (u, t) in enumerate(clicks)], "user_id long, event_id long, at_ms long")
    out = {}
    for r in throttle(df, "user_id", **options).collect():
        out.setdefault(r.user_id, []).append(r.at_ms)
    return {u: sorted(ts) for u, ts in out.items()}


def test_throttle_golden(spark):
    assert throttled(spark, [(1, t) for t in (0, 600, 1000, 1500, 2100)]) == {1: [0, 1000, 2100]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_throttle_equals_loop_over_slice_borders(spark, seed):
    """One hot user with hardly any pause, so that the carry matters at every border."""
    rng = random.Random(seed)
    clicks = [(0, rng.randrange(60_000)) for _ in range(1500)] + [(0, 600 * n) for n in range(150)]
    clicks += [(u, rng.randrange(60_000)) for u in range(1, 6) for _ in range(40)]
    got = throttled(spark, clicks, slice_ms=2500)
    for user in range(6):
        assert got[user] == greedy([t for u, t in clicks if u == user])


def test_numbered_over_slices(spark):
    rows = [(i % 2, i * 7 % 101) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, p int")
    at = cuts(df, F.col("p"), 10)
    assert len(at) > 5
    got = numbered(sliced(df, F.col("p"), at), ["k"], ["p"], "n").collect()
    for k in (0, 1):
        ordered = sorted((r.p, r.n) for r in got if r.k == k)
        assert [n for _, n in ordered] == list(range(1, len(ordered) + 1))


def test_throttle_of_a_user_without_a_pause(spark):
    """Some 12,000 slices in one chain."""
    clicks = [(1, 600 * n) for n in range(20_000)]
    assert throttled(spark, clicks, slice_ms=1001)[1] == greedy([t for _, t in clicks])


@pytest.mark.parametrize("spread", [3_600, 365 * 86_400])
def test_slices_are_even_however_dense_the_rows(spark, spread):
    """An hour or a year, nine tenths of the rows in one key: no slice holds much more than its share."""
    df = spark.range(40_000).select((F.col("id") * F.col("id") % 1_000_003 * spread / 1_000_003).alias("p"),
                                    F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("k"))
    at = cuts(df, F.col("p"), 1_000)
    counts = [r["count"] for r in sliced(df, F.col("p"), at).groupBy(SLICE).count().collect()]
    assert 35 <= len(counts) <= 45 and max(counts) < 1_500 and sum(counts) == 40_000


def test_slices_of_awkward_positions(spark):
    df = spark.createDataFrame([(None,), (1.0,), (1.0,), (2.0,), (-5.0,)], "p double")
    assert cuts(df.where("false"), F.col("p")) == [] and cuts(df, F.col("p")) == []
    got = sorted(((r.p, r[SLICE]) for r in sliced(df, F.col("p"), [1.0, 1.5]).collect()), key=str)
    assert got == [(-5.0, 0), (1.0, 1), (1.0, 1), (2.0, 2), (None, None)]
    assert {r[SLICE] for r in sliced(df, F.col("p"), []).collect()} == {None, 0}


def test_dense_log_and_run_spread_over_slices(spark):
    """A log within a second, and a run with nine tenths of the events, against plain loops."""
    rng = random.Random(9)
    rows = [(0 if rng.random() < .9 else 1, i, T0 + dt.timedelta(milliseconds=rng.randrange(900)), rng.choice("abc"),
             rng.choice(["start", "start", "stop"])) for i in range(800)]
    frame = spark.createDataFrame(rows, "run_id long, event_id long, ts timestamp, step_id string, action string")
    got = {(r.run_id, r.event_id): r.end_ms for r in runs.step_durations(frame, rows=50).collect()}
    want = {}
    for run in (0, 1):
        events = sorted(((t, i, s, a) for r, i, t, s, a in rows if r == run))
        for no, (t, i, s, a) in enumerate(events):
            if a == "start":
                same = next((k for k in range(no + 1, len(events)) if events[k][2:] == (s, "start")), len(events))
                stops = [e[0] for e in events[no + 1:same] if e[2:] == (s, "stop")]
                starts = [e[0] for e in events[no + 1:] if e[3] == "start"]
                end = max(stops) if stops else starts[0] if starts else None
                want[run, i] = end and round((end - T0.replace(tzinfo=None)).total_seconds() * 1000)
    base = round(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert {k: v if v is None else v - base for k, v in got.items()} == want
    logged = [(i, t, f"Phase {i % 5}" if i % 17 == 0 else "x") for i, (_, _, t, _, _) in enumerate(rows)]
    log = spark.createDataFrame(logged, "id long, ts timestamp, message string")
    ordered = sorted(logged, key=lambda r: (r[1], r[0]))
    named = [int(m[-1]) if m != "x" and m[-1] in "1234" else 0 for _, _, m in ordered]
    phases = {r.id: r.phase for r in logs.phase_window(log, rows=40, block=30).collect()}
    assert phases == {ordered[i][0]: max(named[max(0, i - 9):i + 1]) for i in range(len(ordered))}


def test_state_of_the_run_over_its_messages(spark):
    """A running process is at least in phase 1, formatting is phase 4 whatever the messages say."""
    frame = log_frame(spark, ["x", "Phase 3", "y"])
    assert [logs.current_phase(log_frame(spark, ["x"]), is_processing=p, is_formatting=f).first().phase
            for p, f in ((False, False), (True, False), (False, True), (True, True))] == [0, 1, 4, 4]
    assert logs.current_phase(frame, is_processing=True).first().phase == 3
    got = {r.id: r.phase for r in logs.phase_window(frame, is_processing=F.col("id") < 2, is_formatting=F.col("id") == 2).collect()}
    assert got == {0: 1, 1: 3, 2: 4}


def log_frame(spark, messages, minutes=7):
    rows = [(i, T0 + dt.timedelta(minutes=minutes * i), "info", "server", m) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "id long, ts timestamp, level string, source string, message string")


SCENARIOS = [
    (["🚀 Phase 1: Starting text extraction", "page 1 of 5", "page 2 of 5"], 1, 1),
    (["🚀 Phase 1: extraction complete", "🧠 Phase 2: analysing", "whole document"], 2, 2),
    (["🧠 Phase 2: complete", "⚡ Phase 3: correction", "page 3"], 3, 3),
    (["⚡ Phase 3: complete", "🔖 Phase 4: footnotes", "one found"], 4, 4),
    (["🔖 Phase 4: complete", "🎨 Phase 5: final formatting", "all text"], 4, 5),
]


@pytest.mark.parametrize("messages, four, five", SCENARIOS)
def test_phase_scenarios(spark, messages, four, five):
    frame = log_frame(spark, messages)
    assert logs.current_phase(frame).first().phase == four
    assert logs.current_phase(frame, words=P.PHASE_WORDS_FIVE).first().phase == five


def test_phase_window_blocks(spark):
    rng = random.Random(3)
    messages = [rng.choice(["x", "x", "x", "Phase 1", "Phase 2", "Phase 3", "y", "z"]) for _ in range(200)]
    got = {r.id: r.phase for r in logs.phase_window(log_frame(spark, messages), rows=30, block=20).collect()}
    named = [int(m[-1]) if m.startswith("Phase") else 0 for m in messages]
    assert got == {i: max(named[max(0, i - 9):i + 1]) for i in range(200)}


def test_log_intake_and_filters(spark):
    posted = spark.createDataFrame([("info", "m", None), ("", "m", "a"), ("warn", None, "a"), ("warn", "n", "a")],
                                   "level string, message string, source string")
    assert sorted((r.level, r.source) for r in logs.accept_logs(posted).collect()) == [("info", "frontend"), ("warn", "a")]
    errors = spark.createDataFrame([("boom", None), ("", "x")], "error string, source string")
    assert [r.error for r in logs.accept_errors(errors).collect()] == ["[frontend] boom"]
    frame = log_frame(spark, ["keep", "Logs requested", "GET /api/debug/x"])
    assert [r.message for r in logs.log_query(frame).collect()] == ["keep"]


def steps(spark, *events):
    rows = [(1, i, T0 + dt.timedelta(milliseconds=ms), step, action) for i, (ms, step, action) in enumerate(events)]
    return spark.createDataFrame(rows, "run_id long, event_id long, ts timestamp, step_id string, action string")


def test_step_durations(spark):
    frame = steps(spark, (0, "a", "start"), (5000, "b", "start"), (9000, "a", "stop"), (20_000, "c", "start"),
                  (30_000, "a", "start"), (31_000, "a", "stop"), (40_000, "d", "stop"))
    for size in (1, 3, 100):
        got = {(r.step_id, r.event_id): r.duration_ms for r in runs.step_durations(frame, size).collect()}
        assert got == {("a", 0): 9000, ("b", 1): 15_000, ("c", 3): 10_000, ("a", 4): 1000}


def test_task_lookup(spark):
    rows = [(1, 1, T0, "s", "started"), (1, 2, T0, "s", "completed"), (1, 3, T0, "s", "failed"), (2, 4, T0, "s", "started")]
    status = runs.task_status(spark.createDataFrame(rows, "task_id long, event_id long, ts timestamp, step string, status string"))
    asked = spark.createDataFrame([(1,), (2,), (3,)], "task_id long")
    assert {r.task_id: r.answer for r in runs.task_lookup(asked, status).collect()} == {
        1: "result", 2: "Task not completed yet", 3: "Task not found"}


def test_session_compaction(spark):
    df = spark.createDataFrame(
        [(1, [str(i) for i in range(150)], [("a", "data:x")]), (2, ["l"], [("b", None)])],
        "id long, debug_logs array<string>, results array<struct<text: string, image_url: string>>")
    out = {r.id: r for r in sessions.compact_sessions(df, limit=200).collect()}
    assert out[1].debug_logs == [str(i) for i in range(50, 150)] and out[1].results[0].image_url == "compressed"
    assert out[2].debug_logs == ["l"] and out[2].results[0].image_url is None
