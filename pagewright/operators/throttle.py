"""Greedy throttle: an event passes if at least ``gap`` ms lie since the last one that passed.

What passes depends on all before it, so one window or one group per user would hold a user's
whole history in a task. Instead every (user, time slice) is solved for each way it can be
entered - the carry only matters for the first event taken, and that lies within ``gap`` ms of
the slice start or is the first event at all. These small tables, step functions of the carry, are
walked in order, a row at a time and with nothing kept but the carry; a second pass replays each
slice from its true entry. Events of one user in the same millisecond are reduced to the first
beforehand, so a slice holds at most ``slice_ms`` events.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .slices import SLICE, fixed, within

GAP_MS = 1000
HOUR_MS = 3_600_000

# Ship the helpers below with the tasks, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted batches regrouped so that no (key, slice) is cut, with the start index of each."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        starts = _starts(held, key)
        if len(starts) > 1:
            yield held.iloc[:starts[-1]], starts[:-1]
            held = held.iloc[starts[-1]:].reset_index(drop=True)
    if held is not None and len(held):
        yield held, _starts(held, key)


def _starts(pdf: pd.DataFrame, key: str) -> np.ndarray:
    keys, slices = pdf[key].to_numpy(), pdf[SLICE].to_numpy()
    change = (keys[1:] != keys[:-1]) | (slices[1:] != slices[:-1])
    return np.flatnonzero(np.append(True, change)) if len(pdf) else np.array([], dtype=int)


def _follow(at: np.ndarray, starts: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the next event at least ``gap`` later, and the end of each event's own group."""
    sizes = np.diff(np.append(starts, len(at)))
    group = np.repeat(np.arange(len(starts)), sizes)
    ends = np.repeat(starts + sizes, sizes)
    # One coordinate for all groups: local time, groups further apart than any gap.
    local = at - np.repeat(at[starts], sizes)
    along = local + group * (int(local.max(initial=0)) + 2 * gap)
    return np.minimum(np.searchsorted(along, along + gap, side="left"), ends), ends


def throttle(events: DataFrame, key: str, gap: int = GAP_MS, slice_ms: int = HOUR_MS) -> DataFrame:
    """Events that pass, from ``key, event_id, at_ms``; ties within a millisecond go to the lowest id.

    Keys are not NULL and times not negative.
    """
    if slice_ms <= gap:
        raise ValueError("a slice must be longer than the gap")
    # One shuffle by (key, slice) serves the reduction, both passes and the join between them.
    firsts = (fixed(events.select(key, "event_id", "at_ms"), F.col("at_ms"), slice_ms).repartition(key, SLICE)
              .groupBy(key, SLICE, "at_ms").agg(F.min("event_id").alias("event_id")))
    kind = dict(events.dtypes)[key]

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each possible first event of a slice, the last one that passes."""
        for pdf, starts in _groups(batches, key):
            at, slices = pdf["at_ms"].to_numpy(), pdf[SLICE].to_numpy()
            follow, ends = _follow(at, starts, gap)
            jump = np.where(follow < ends, follow, np.arange(len(at)))
            while True:  # doubling: after k rounds 2^k events are skipped
                further = jump[jump]
                if np.array_equal(further, jump):
                    break
                jump = further
            last = at[jump]
            # Entry candidates: the first event, those the carry can still reach, and the one behind.
            reachable = at < slices * slice_ms + gap
            candidate = reachable | np.append(True, reachable[:-1])
            candidate[starts] = True
            # Neighbouring candidates mostly lead to the same end; the last of each run stands for it.
            final = np.append(ends[:-1] != ends[1:], True) | ~np.append(candidate[1:], False)
            closing = np.flatnonzero(candidate & (final | (last != np.append(last[1:], -1))))
            out = {key: pdf[key].to_numpy(), SLICE: slices, "up_to": at, "last_at": last}
            yield pd.DataFrame({name: values[closing] for name, values in out.items()})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The carry that enters each slice: none, or the last event that passes before it."""
        user, carried = None, -1
        for pdf, starts in _groups(batches, key):
            users, up_to, last = (pdf[name].tolist() for name in (key, "up_to", "last_at"))
            ends, entered = [*starts.tolist()[1:], len(users)], []
            for start, end in zip(starts.tolist(), ends, strict=True):
                if users[start] != user:
                    user, carried = users[start], -1
                entered.append(carried)
                at = start if carried < 0 else bisect_left(up_to, carried + gap, start, end)
                carried = last[at] if at < end else carried
            yield pdf.iloc[starts][[key, SLICE]].assign(carried=entered)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _groups(batches, key):
            at, carried = pdf["at_ms"].to_numpy(), pdf["carried"].to_numpy()
            follow, ends = _follow(at, starts, gap)
            blocked = (at < carried + gap) & (carried >= 0)
            current = starts + np.add.reduceat(blocked.astype(int), starts)
            ends = ends[starts]
            taken = np.zeros(len(at), dtype=bool)
            while True:  # one step of every group at a time
                alive = current < ends
                current, ends = current[alive], ends[alive]
                if not len(current):
                    break
                taken[current] = True
                current = follow[current]
            yield pdf.loc[taken, [key, "event_id", "at_ms"]]

    def in_order(df: DataFrame) -> DataFrame:
        """Whole slices in time order. The window makes that a requirement no later planning may undo."""
        return df.withColumn("_at", F.row_number().over(within([key], ["at_ms"])))

    table = in_order(firsts).mapInPandas(entries, f"{key} {kind}, {SLICE} bigint, up_to bigint, last_at bigint")
    whole = Window.partitionBy(key).orderBy(SLICE, "up_to")
    chained = table.withColumn("_at", F.row_number().over(whole)).mapInPandas(walk, f"{key} {kind}, {SLICE} bigint, carried bigint")
    return in_order(firsts.join(chained, [key, SLICE])).mapInPandas(replay, f"{key} {kind}, event_id bigint, at_ms bigint")
