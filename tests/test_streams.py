"""Streams over many small batches against one batch, replays, crashes and expiry."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from pagewright.operators.throttle import throttle
from pagewright.plans import derived
from pagewright.sources.versioned import VersionedTable
from pagewright.streaming import feeds, running, stateful

VIEWS = {
    "counts": (lambda: feeds.log_count_windows("1 hour"), derived.as_logs),
    "metrics": (feeds.metric_windows, lambda e: e),
    "pages": (feeds.page_progress, lambda e: e.select(F.col("user_id").alias("doc_id"), (F.col("event_type") == "view").alias("is_done"))),
    "tasks": (feeds.task_states, derived.as_task_steps),
    "finished": (feeds.finished_once, derived.as_task_steps),
    "sessions": (feeds.session_windows, lambda e: e),
}


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def shuffled(spark, sf_dir, tmp_path_factory):
    """The events in eleven files, in no order."""
    folder = str(tmp_path_factory.mktemp("events") / "shuffled")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(11, F.rand(7)).write.parquet(folder)
    return folder


@pytest.mark.parametrize("name", VIEWS)
def test_view_over_shuffled_files_equals_one_batch(spark, shuffled, tmp_path, name):
    view, prepare = VIEWS[name][0](), VIEWS[name][1]
    table = VersionedTable(spark, str(tmp_path / "table"))
    stream = prepare(feeds.read_feed(spark, shuffled, files_per_trigger=1))
    running.follow(view, stream, table, str(tmp_path / "checkpoint")).awaitTermination()
    whole = prepare(feeds.read_feed(spark, shuffled))
    assert rows(running.now(view, table)) == rows(running.run(view, whole, name))
    assert table.version().notes == {"feed": 10} and len(table.version().folders) <= running.MOST_FOLDERS


def test_state_is_as_large_as_the_keys(spark, shuffled, tmp_path):
    view, prepare = VIEWS["tasks"][0](), VIEWS["tasks"][1]
    table = VersionedTable(spark, str(tmp_path / "table"))
    events = prepare(feeds.read_feed(spark, shuffled, files_per_trigger=1))
    running.follow(view, events, table, str(tmp_path / "checkpoint")).awaitTermination()
    keys = running.now(view, table).count()
    table.compact(view.merge)
    assert table.read().count() == keys < spark.read.parquet(shuffled).count()
    assert running.now(view, table).count() == keys


def test_replayed_and_broken_batches(spark, tmp_path, monkeypatch):
    view = feeds.page_progress()
    table = VersionedTable(spark, str(tmp_path / "table"))

    def batch(*done):
        return spark.createDataFrame([(1, d) for d in done], "doc_id long, is_done boolean")

    running.land(view, table, batch(True, False), 0)
    running.land(view, table, batch(True, False), 0)
    assert rows(running.now(view, table)) == [(1, 1, 2)]
    with monkeypatch.context() as broken:
        broken.setattr(VersionedTable, "_create", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            running.land(view, table, batch(True), 1)
    assert rows(running.now(view, table)) == [(1, 1, 2)]
    running.land(view, table, batch(True), 1)
    running.land(view, table, batch(False), 1, feed="other")
    assert rows(running.now(view, table)) == [(1, 2, 4)]


def test_no_rows_at_all(spark, tmp_path):
    folder = str(tmp_path / "none")
    spark.createDataFrame([], "user_id long, ts timestamp, value double").write.parquet(folder)
    assert running.run(feeds.metric_windows(), feeds.read_feed(spark, folder), "none").count() == 0
    assert running.run(feeds.session_windows(), feeds.read_feed(spark, folder), "none").count() == 0


def test_sessions_merge_over_batches(spark, tmp_path):
    """A batch that fills the pause between two sessions makes one of them; a pause of the gap itself parts them."""
    view, table = feeds.session_windows("30 minutes"), VersionedTable(spark, str(tmp_path / "table"))
    t0 = dt.datetime(2024, 1, 1)

    def batch(number, *minutes):
        events = spark.createDataFrame([(1, t0 + dt.timedelta(minutes=m)) for m in minutes], "user_id long, ts timestamp")
        running.land(view, table, events, number)
        return [(r.events, r.duration_ms // 60_000) for r in running.now(view, table).orderBy("session_start").collect()]

    assert batch(0, 0, 50, 200) == [(1, 0), (1, 0), (1, 0)]
    assert batch(1, 170) == [(1, 0), (1, 0), (1, 0), (1, 0)]
    assert batch(2, 25, 5) == [(4, 50), (1, 0), (1, 0)]


# ------------------------------------------------------------------ stateful
def as_files(spark, df, folder, shuffled=True):
    dealt = df.repartition(6, F.rand(3)) if shuffled else df.repartitionByRange(6, "ts")
    dealt.write.parquet(folder)
    for number, name in enumerate(sorted(glob.glob(f"{folder}/part-*"))):  # a stream takes files by their time
        os.utime(name, (1_700_000_000 + number,) * 2)
    return folder


def state_rows(query):
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])


@pytest.mark.parametrize("shuffled, delay", [(True, "60 days"), (False, "1 second")])
def test_stateful_throttle_equals_batch(spark, sf_dir, tmp_path, shuffled, delay):
    """Six files, one a trigger: in any order within the delay the clicks of the batch operator, and no state is left."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = as_files(spark, events, str(tmp_path / "files"), shuffled)
    own = stateful.stateful_session(spark)
    feed = stateful.EndedFeed(derived.as_clicks(feeds.read_feed(own, folder, files_per_trigger=1)), "throttle")
    out = stateful.throttled(feed.stream, delay=delay)
    first = feed.drain(out)
    held = state_rows(first)
    early = spark.read.schema(out.schema).parquet(f"{feed.folder}/table").count()
    feed.close()
    last = feed.drain(out)
    got = spark.read.schema(out.schema).parquet(f"{feed.folder}/table")
    assert rows(got) == rows(throttle(derived.clicks(spark, sf_dir), "user_id"))
    assert held > 0 and state_rows(last) == 0 and (early > 0) == (not shuffled)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider") is False


def feed_of(spark, steps, subscriptions, name="status", **options):
    own = stateful.stateful_session(spark)
    feed = stateful.EndedFeed(stateful.status_feed_rows(own.readStream.schema(steps[1]).option("maxFilesPerTrigger", 1).parquet(steps[0]),
                                                        own.readStream.schema(subscriptions[1]).parquet(subscriptions[0])), name)
    return feed.run(stateful.status_feeds(feed.stream, **options), spark)


def test_status_feed_halfway(spark, tmp_path):
    """Snapshot, later steps, close; nothing for steps behind the end; an ended task is unknown once its time is over."""
    steps = [(1, 10, 1000, "started", "a"), (1, 11, 2000, "started", "b"), (1, 12, 4000, "started", "c"),
             (1, 13, 5000, "completed", "d"), (1, 14, 6000, "failed", "e"), (2, 15, 1000, "started", "f")]
    subscriptions = [(91, 1, 3000), (92, 1, 3000), (93, 1, 5500), (94, 1, 900_000), (95, 3, 10), (96, 2, 2000), (97, 2, 10)]
    paths = [str(tmp_path / "steps"), str(tmp_path / "subs")]
    frames = [spark.createDataFrame(steps, "task_id long, event_id long, at_ms long, status string, message string"),
              spark.createDataFrame(subscriptions, "sub_id long, task_id long, at_ms long")]
    for frame, path in zip(frames, paths, strict=True):
        frame.repartition(4, F.rand(1)).write.parquet(path)
    out = feed_of(spark, (paths[0], frames[0].schema), (paths[1], frames[1].schema), keep_ms=60_000, delay="1 hour")
    got = {}
    for r in out.orderBy("sub_id", "number").collect():
        got.setdefault(r.sub_id, []).append((r.number, r.kind, r.event_id))
    halfway = [(0, "snapshot", 11), (1, "update", 12), (2, "update", 13), (3, "close", None)]
    assert got == {91: halfway, 92: halfway, 93: [(0, "snapshot", 13), (1, "close", None)], 94: [(0, "missing", None)],
                   95: [(0, "missing", None)], 96: [(0, "snapshot", 15)], 97: [(0, "missing", None)]}
    texts = [r.record for r in out.filter("sub_id = 93").orderBy("number").collect()]
    assert texts == ['data: {"status":"completed","message":"d","timestamp":"1970-01-01T00:00:05.000Z"}\n\n',
                     "event: close\ndata: Stream complete\n\n"]


def test_status_feed_does_not_depend_on_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = as_files(spark, events, str(tmp_path / "files"))
    own = stateful.stateful_session(spark)

    def run(source):
        feed = stateful.EndedFeed(stateful.status_feed_rows(derived.as_feed_steps(source), derived.as_subscriptions(source)), "status")
        return rows(feed.run(stateful.status_feeds(feed.stream, delay="60 days"), spark))

    assert run(feeds.read_feed(own, folder, files_per_trigger=1)) == run(feeds.read_feed(own, sf_dir, "events.parquet"))
