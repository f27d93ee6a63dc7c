"""Stateful streams: throttled clicks and status feeds, row by row, with state that expires.

Both keep state per key in Spark's state store (RocksDB) and use event-time timers. Rows wait until the watermark has
passed them, so within the allowed delay their order of arrival does not matter; rows behind the watermark are dropped,
as the answers before them are out. A feed that has ended is closed by a heartbeat, which moves the watermark past all rows.
"""

from __future__ import annotations

import datetime as dt
import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import patterns as P
from ..session import run_folder

GAP_MS, DAY_MS = 1000, 86_400_000
#: Behind all rows, as far as pandas can tell time: 2200-01-01.
END_MS = 7_258_118_400_000

# Ship the processors with the tasks, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session with the state store that these streams need, beside the caller's."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


class EndedFeed:
    """A feed that can be closed: its rows, and a folder for the heartbeat that ends it."""

    def __init__(self, rows: DataFrame, name: str) -> None:
        spark = rows.sparkSession
        self.spark, self.schema, self.folder = spark, rows.schema, run_folder(spark, name)
        spark.createDataFrame([], rows.schema).write.parquet(f"{self.folder}/heartbeat")
        self.stream = rows.unionByName(spark.readStream.schema(rows.schema).parquet(f"{self.folder}/heartbeat"))

    def drain(self, out: DataFrame) -> StreamingQuery:
        """Process all that is available."""
        query = (out.writeStream.format("parquet").outputMode("append").option("path", f"{self.folder}/table")
                 .option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
        return query

    def close(self) -> None:
        """Send the heartbeat: the next drain sets free all that still waits."""
        beat = [F.lit(END_MS if field.name == "at_ms" else None).cast(field.dataType).alias(field.name) for field in self.schema]
        self.spark.range(1).select(*beat).write.mode("append").parquet(f"{self.folder}/heartbeat")

    def run(self, out: DataFrame, read: SparkSession) -> DataFrame:
        """Process all rows, end the feed, process what that sets free; the stream goes on from its checkpoint."""
        self.drain(out)
        self.close()
        self.drain(out)
        return read.read.schema(out.schema).parquet(f"{self.folder}/table")


def _timed(rows: DataFrame, key: str, delay: str) -> DataFrame:
    """Rows with a watermark; those without a key, as heartbeats are, move it and go no further.

    The test names the time as well, or the optimizer would put it before the watermark.
    """
    timed = rows.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", delay)
    return timed.filter(F.when(F.col(key).isNotNull(), F.col("ts").isNotNull()))


class _Waiting(StatefulProcessor):
    """Holds rows until the watermark has passed them and hands them on in order."""

    def hold(self, handle: StatefulProcessorHandle, row: str) -> None:
        self.handle, self.names = handle, [part.split()[0] for part in row.split(", ")]
        self.waiting = handle.getListState("waiting", row)
        self.due = handle.getValueState("due", "at long")

    def wake(self, at: int) -> None:
        """One timer a key: the earliest that is asked for."""
        due = self.due.get()
        if due is None or at < due[0]:
            if due is not None:
                self.handle.deleteTimer(due[0])
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            values = list(zip(*(batch[name].tolist() for name in self.names), strict=True))
            if values:
                self.waiting.appendList(values)
                earliest = min(value[0] for value in values)
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.wake(first + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.due.clear()
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [row for row in rows if row[0] < passed]
        rest = rows[len(ready):]
        if rest:
            self.waiting.put(rest)
            self.wake(rest[0][0] + 1)
        else:
            self.waiting.clear()
        yield from self.answer(key, ready, passed, bool(rest))

    def answer(self, key, ready: list[tuple], passed: int, more: bool) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


# ------------------------------------------------------------------ throttle
class Throttle(_Waiting):
    """Clicks that pass: at least the gap after the last one that passed, the lowest id of a millisecond.

    State: clicks the watermark has not passed yet, and the last that passed, until the gap behind it is over.
    """

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hold(handle, "at_ms long, event_id long")
        self.last = handle.getValueState("last", "at long")

    def answer(self, key, ready, passed, more) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for at, event in ready:
            if last is None or at - last >= self.gap:
                kept.append((key[0], event, at))
                last = at
        if last is None or (last + self.gap <= passed and not more):
            self.last.clear()
        else:
            self.last.update((last,))
            if not more:
                self.wake(last + self.gap)
        if kept:
            yield pd.DataFrame(kept, columns=["user_id", "event_id", "at_ms"])


def throttled(clicks: DataFrame, gap: int = GAP_MS, delay: str = "10 minutes") -> DataFrame:
    """Clicks ``user_id, event_id, at_ms`` that pass, as a stream; late ones wait for up to the delay. NULL users are ignored."""
    timed = _timed(clicks.select("user_id", "event_id", "at_ms"), "user_id", delay)
    return timed.groupBy("user_id").transformWithStateInPandas(
        Throttle(gap), "user_id long, event_id long, at_ms long", "append", "eventtime")


# ------------------------------------------------------------------ status feeds
NOT_FOUND, CLOSED = "Task not found", "Stream complete"


class StatusFeed(_Waiting):
    """Answers subscriptions to a task: a snapshot, each later step as an update, a closing record; each once.

    State: the task's last step, its open subscriptions, and rows the watermark has not passed yet. A task ends with its
    first terminal step, later ones are ignored; once the keep time behind that is over its state is dropped, and the task
    is unknown again. That goes by the times of the rows, so batches do not matter.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # The rank orders rows of one moment: steps before subscriptions.
        self.hold(handle, "at_ms long, rank int, event_id long, status string, message string, sub_id long")
        self.state = handle.getValueState("state", "at long, event_id long, status string, message string")
        self.open = handle.getListState("open", "sub_id long, number int")

    def answer(self, key, ready, passed, more) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        subscribers = {row[0]: row[1] for row in self.open.get()} if self.open.exists() else {}
        out: list[tuple] = []

        def send(sub: int, number: int, kind: str, event: int | None, record: str) -> None:
            out.append((key[0], sub, number, kind, event, record))

        def data(step: tuple) -> str:
            at = dt.datetime.fromtimestamp(step[0] / 1000, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
            body = {"status": step[2], "message": step[3], "timestamp": at}
            return f"data: {json.dumps(body, ensure_ascii=False, separators=(',', ':'))}\n\n"

        closing = f"event: close\ndata: {CLOSED}\n\n"
        for at, rank, event, status, message, sub in ready:
            over = state is not None and state[2] in P.TERMINAL_STATES
            if over and at > state[0] + self.keep:
                state, over = None, False
            if rank:
                if state is None:
                    send(sub, 0, "missing", None, json.dumps({"error": NOT_FOUND}, separators=(",", ":")))
                    continue
                send(sub, 0, "snapshot", state[1], data(state))
                if over:
                    send(sub, 1, "close", None, closing)
                else:
                    subscribers[sub] = 1
            elif not over:
                state = (at, event, status, message)
                ends = status in P.TERMINAL_STATES
                for sub, number in subscribers.items():
                    send(sub, number, "update", event, data(state))
                    if ends:
                        send(sub, number + 1, "close", None, closing)
                subscribers = {} if ends else {sub: number + 1 for sub, number in subscribers.items()}
        ended = state is not None and state[2] in P.TERMINAL_STATES
        if state is None or (ended and state[0] + self.keep < passed and not more):
            self.state.clear()
            self.open.clear()
        else:
            self.state.update(state)
            self.open.put(list(subscribers.items())) if subscribers else self.open.clear()
            if ended and not more:
                self.wake(state[0] + self.keep + 1)
        if out:
            yield pd.DataFrame(out, columns=["task_id", "sub_id", "number", "kind", "event_id", "record"]).astype(
                {"event_id": "Int64"})


def status_feed_rows(steps: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Steps ``task_id, event_id, at_ms, status, message`` and subscriptions ``sub_id, task_id, at_ms`` as one feed."""
    # No NULLs: pandas would read integers beside them as floating-point numbers.
    zero, none = F.lit(0).cast("long"), F.lit("")
    return steps.select("task_id", "at_ms", F.lit(0).alias("rank"), "event_id", "status", "message",
                        zero.alias("sub_id")).unionByName(
        subscriptions.select("task_id", "at_ms", F.lit(1).alias("rank"), zero.alias("event_id"), none.alias("status"),
                             none.alias("message"), "sub_id"))


def status_feeds(rows: DataFrame, delay: str = "10 minutes", keep_ms: int = DAY_MS) -> DataFrame:
    """Records ``task_id, sub_id, number, kind, event_id, record`` of every subscription, as a stream.

    ``number`` orders the records of a subscription; ``record`` is their event-stream text.
    """
    return _timed(rows, "task_id", delay).groupBy("task_id").transformWithStateInPandas(
        StatusFeed(keep_ms), "task_id long, sub_id long, number int, kind string, event_id long, record string",
        "append", "eventtime")
