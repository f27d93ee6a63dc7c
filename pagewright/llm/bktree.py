"""BK-trees over integer fingerprints, one tree per shard of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class BKTree:
    """Fingerprints in a tree whose children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, wanted: int, radius: int) -> list[int]:
        """Places of all fingerprints within the radius: only edges of d - radius .. d + radius can lead to them."""
        found, open_nodes = [], [0] if self.prints else []
        while open_nodes:
            at = open_nodes.pop()
            d = (self.prints[at] ^ wanted).bit_count()
            if d <= radius:
                found.append(at)
            open_nodes += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]
        return found

    def add(self, new: int) -> None:
        """Hang the fingerprint below the last node on its path of equal distances."""
        at = 0
        while self.prints:
            d = (self.prints[at] ^ new).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = len(self.prints)
                break
            at = self.children[at][d]
        self.prints.append(new)
        self.children.append({})


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect exactly what all pairs within the radius connect: at most one per value."""
    tree, over = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while over[i] != i:
            over[i] = over[over[i]]
            i = over[i]
        return i

    links = []
    for i, value in enumerate(values):
        for j in tree.near(value, radius):
            if (a := top(i)) != (b := top(j)):
                over[a] = b
                links.append((value, values[j]))
        tree.add(value)
    return links


def linked(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b): links within each shard of (shard, key, fp), all long, fp distinct within a shard.

    Rows of a shard meet in one partition, sorted, and its tree lives only while they pass.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 3), np.int64)

        def links(rows: np.ndarray) -> pa.RecordBatch:
            out = []
            if len(rows) > 1:
                cuts = np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(axis=1)) + 1
                starts, ends = np.r_[0, cuts], np.r_[cuts, len(rows)]
                for k in np.flatnonzero(ends - starts > 1):
                    prints = rows[starts[k]:ends[k], 2].astype(np.uint64).tolist()
                    out += shard_links(prints, radius)
            pairs = np.array(out, np.uint64).reshape(-1, 2).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            rows = np.vstack([rest, np.column_stack([batch.column(i).to_numpy() for i in range(3)])])
            # The last shard may go on in the next batch.
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield links(rows[:cut])
            rest = rows[cut:]
        yield links(rest)

    sorted_rows = keyed.select("shard", "key", "fp").repartition("shard", "key").sortWithinPartitions("shard", "key")
    return sorted_rows.mapInArrow(run, "a long, b long")
