"""Benchmark passages in documents: SimHash of item-sized windows, multi-index lookup, exact similarity."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_batch, table
from .simhash import BITS, simhash

WORD = re.compile(r"[^\W_]+")
#: Items that one pass over the documents looks for; a larger benchmark takes several passes.
BLOCK_ITEMS = 20_000
#: Entries of the table that says which shingle hashes can occur in an item (a power of two).
FILTER_BITS = 22
#: Shingles whose bits are summed at a time while windows are fingerprinted.
SUMMED = 4_096


def shingles(words: list[str], size: int) -> list[str]:
    return [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Shingles weigh as often as they occur: sum of minima over sum of maxima."""
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return common / (a.total() + b.total() - common)


class Fingerprints:
    """Items by SimHash: block tables that together hold every item within the radius of a wanted fingerprint.

    With `blocks` blocks, fingerprints within the radius differ by at most radius // blocks bits in one of them.
    """

    def __init__(self, prints: list[int], radius: int, blocks: int = 7) -> None:
        self.prints, self.radius, self.flips = prints, radius, radius // blocks
        cuts = [round(BITS * i / blocks) for i in range(blocks + 1)]
        self.blocks = list(zip(cuts, cuts[1:], strict=False))
        self.tables: list[dict[int, list[int]]] = []
        for low, high in self.blocks:
            held = defaultdict(list)
            for i, p in enumerate(prints):
                held[p >> low & (1 << high - low) - 1].append(i)
            self.tables.append(held)

    def near(self, wanted: int) -> set[int]:
        found: set[int] = set()
        for (low, high), held in zip(self.blocks, self.tables, strict=True):
            value = wanted >> low & (1 << high - low) - 1
            for k in range(self.flips + 1):
                for bits in combinations(range(high - low), k):
                    found.update(held.get(value ^ sum(1 << b for b in bits), ()))
        return {i for i in found if (self.prints[i] ^ wanted).bit_count() <= self.radius}


class Benchmark:
    """A block of items, ready to be looked for in texts."""

    def __init__(self, items: list[tuple[int, str]], size: int, radius: int, least: float) -> None:
        self.size, self.least = size, least
        self.items = [(i, w) for i, t in items if (w := WORD.findall((t or "").lower()))]
        self.counts = [Counter(shingles(w, size)) for _, w in self.items]
        self.index = Fingerprints([self.print_of(w) for _, w in self.items], radius)
        #: By shingle size (items shorter than `size` are one shingle): hash -> items that hold it.
        self.places: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, w) in enumerate(self.items):
            n = min(size, len(w))
            for h in sorted(set(self.rolling(self.word_hashes(w), n).tolist())):
                self.places[n][h].append(k)
        self.maybe = {}
        for n, held in self.places.items():
            self.maybe[n] = np.zeros(1 << FILTER_BITS, bool)
            self.maybe[n][np.array(list(held), np.uint64) >> np.uint64(64 - FILTER_BITS)] = True

    def print_of(self, words: list[str]) -> int:
        digests = [xxhash.xxh64_intdigest(s, 42) for s in shingles(words, self.size)]
        return simhash(np.array(digests, np.uint64)) & (1 << BITS) - 1

    @staticmethod
    def word_hashes(words: list[str]) -> np.ndarray:
        # Python's own hash only finds places to look at; its seed has no influence on results.
        return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)

    @staticmethod
    def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
        last = max(0, len(hashes) - n + 1)
        total = np.zeros(last, np.uint64)
        for k in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + last]
        return total

    def windows(self, words: list[str]) -> list[tuple[int, int]]:
        """(start, words) of all item-sized windows that can reach the wanted similarity, in order.

        A window can have in common with an item no more shingles than it has places whose shingle the item holds. With a
        shingles of its own and b of the item, the similarity is at most places / (a + b - places): the windows with too
        few places for it, and no others, are left out, wherever in the item their shingles lie.
        """
        found, hashes = set(), self.word_hashes(words)
        for n, held in self.places.items():
            rolled = self.rolling(hashes, n)
            hits = np.flatnonzero(self.maybe[n][rolled >> np.uint64(64 - FILTER_BITS)])
            of_item = defaultdict(list)
            for at, h in zip(hits.tolist(), rolled[hits].tolist(), strict=True):
                for k in held.get(h, ()):
                    of_item[k].append(at)
            for k, places in of_item.items():
                size = len(self.items[k][1])
                a = max(1, min(size, len(words)) - n + 1)
                # One millionth less, for the rounding of the division.
                need = max(1, math.ceil(self.least * (a + self.counts[k].total()) / (1 + self.least) - 1e-6))
                last = max(0, len(words) - size)
                for first, final in zip(places, places[need - 1:], strict=False):
                    found.update((s, size) for s in range(max(0, final - a + 1), min(first, last) + 1))
        return sorted(found)

    def prints_of(self, words: list[str], windows: list[tuple[int, int]]) -> Iterator[int]:
        """The fingerprint of each of the sorted windows: bits are summed along the text and windows are differences."""
        sums, low, high = None, 0, 0
        for start, size in windows:
            if min(size, len(words)) <= self.size:
                yield self.print_of(words[start:start + size])
                continue
            a = min(size, len(words)) - self.size + 1
            if sums is None or start < low or start + a > high:
                low, high = start, max(start + a, min(start + SUMMED, len(words) - self.size + 1))
                digests = [xxhash.xxh64_intdigest(s, 42) for s in shingles(words[low:high + self.size - 1], self.size)]
                bits = np.unpackbits(np.array(digests, np.uint64).view(np.uint8).reshape(-1, BITS // 8), axis=1,
                                     bitorder="little")
                sums = np.zeros((high - low + 1, BITS), np.int32)
                np.cumsum(bits, axis=0, out=sums[1:], dtype=np.int32)
            counts = sums[start - low + a] - sums[start - low]
            yield int(np.packbits(2 * counts > a, bitorder="little").view(np.uint64)[0])

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """(item_id, first word, words, differing bits, similarity) of the best window of each leaked item."""
        words = WORD.findall((text or "").lower())
        best: dict[int, tuple[int, int, int, int, float]] = {}
        windows = self.windows(words)
        for (start, size), wanted in zip(windows, self.prints_of(words, windows), strict=True):
            part, counts = words[start:start + size], None
            for k in self.index.near(wanted):
                item_id, item = self.items[k]
                if len(item) != size:
                    continue
                counts = counts or Counter(shingles(part, self.size))
                similarity = weighted_similarity(counts, self.counts[k])
                if similarity >= self.least and (k not in best or similarity > best[k][4]):
                    best[k] = (item_id, start, size, (self.index.prints[k] ^ wanted).bit_count(), similarity)
        return [best[k] for k in sorted(best)]


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about BLOCK_ITEMS items; one that fits in a block needs one pass."""
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    n = -(-items.count() // BLOCK_ITEMS)
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def looker(spark: SparkSession, items: list[tuple[int, str]], size: int, radius: int, least: float):
    """A function that gives the items to a task and builds their index once per task."""
    sent, built = spark.sparkContext.broadcast(items), {}

    def look() -> Benchmark:
        if "b" not in built:
            built["b"] = Benchmark(sent.value, size, radius, least)
        return built["b"]

    return look


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, radius: int = 20,
               least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, bits, similarity): leaked items of each document, best window each.

    Words are runs of letters and digits, lower-cased; similarity is weighted Jaccard over shingles of `size` words.
    Pairs at similarity 0.8 differ by about 10 of 64 bits; the radius of 20 lies over three deviations above.
    NULL and empty texts have no leaks, items without words match nothing; repeated rows are reported for each
    row. Documents are read once per block of items and never shuffled.
    """
    spark, found = docs.sparkSession, []
    for items in blocks_of(benchmark):
        look = looker(spark, items, size, radius, least)

        def work(batch: pa.RecordBatch, look=look) -> dict:
            rows = [(d, *leak) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    for leak in look().leaks(t)]
            names = ("doc_id", "item_id", "start_word", "n_words", "bits", "similarity")
            return dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}

        found.append(by_batch(docs.select(F.col("doc_id").cast("long"), "text"), work,
                              "doc_id long, item_id long, start_word int, n_words int, bits int, similarity double"))
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, start_word int, n_words int, bits int, "
                                         "similarity double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, radius: int = 20,
                  least: float = 0.8) -> DataFrame:
    """The documents without those that hold an item; rows, columns and order of the rest stay."""
    for items in blocks_of(benchmark):
        look, place = looker(docs.sparkSession, items, size, radius, least), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], look=look, place=place) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not look().leaks(t) for t in batch.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaked benchmark items."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
