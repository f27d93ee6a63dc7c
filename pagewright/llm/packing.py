"""Best-fit packing by length patterns: non-negative least squares on the histogram, then best fit for the rest."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import by_batch, stored, table

#: Words kept per Python worker, new words given to the tokenizer at a time, and pieces of one length ranked in one group.
CACHE_WORDS, WORDS_AT_ONCE, GROUP_ROWS = 600_000, 1024, 4096
#: Texts of these characters alone are cut into words here; all others go to the tokenizer whole.
PLAIN = re.compile(r"[\x20-\x7e\n\tÀ-ÖØ-öø-ÿŒœ]*")
#: The word rule of the tokenizer file, on lower case text of such characters.
RULE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\sa-z0-9ß-öø-ÿœ]+")


class WordCache:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer works word by word, so ids of a word never depend on its neighbours and are worked out once.
    Strings of special tokens, and characters for which lower case or composition may differ, take the long way.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def each(self, words: list[str]) -> list[bytes]:
        """Ids of single words, encoded as one text with blanks between them and cut by the tokenizer's word numbers."""
        out: list[bytes] = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at:at + WORDS_AT_ONCE]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            numbers, ids = e.word_ids, np.array(e.ids, "<u4").tobytes()
            if not numbers or numbers[-1] != len(part) - 1:  # some word is none to the tokenizer
                out += self.whole(part)
                continue
            ends = (4 * np.cumsum(np.bincount(numbers, minlength=len(part)))).tolist()
            out += [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [bool(PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        words = [RULE.findall(t.lower()) if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list(set().union(*words).difference(self.known))
        self.known.update(zip(new, self.each(new), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, w)) if p else self.whole([t])[0]
                for t, w, p in zip(texts, words, plain, strict=True)]


@cache
def word_cache(path: str | None) -> WordCache:
    import public_tokenizers

    return WordCache(path or public_tokenizers.path("word_bpe_49k.json"))


def pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the documents as token ids, long ones cut at `capacity`.

    A document is its ids and then `end_id`, so NULL and empty texts have one piece of length 1.
    Every row counts, repeated ones too. The tokenizer file is read on the executors.
    """
    end = np.array([end_id], "<u4").tobytes()

    def work(batch: pa.RecordBatch) -> dict:
        coded = word_cache(tokenizer_path).encode([t or "" for t in batch.column(1).to_pylist()])
        out = defaultdict(list)
        for doc_id, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                for name, value in (("doc_id", doc_id), ("piece", k), ("start", at // 4), ("length", len(part) // 4),
                                    ("ids_crc32", zlib.crc32(part))):
                    out[name].append(value)
        return {n: out[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}

    return by_batch(docs.select(F.col("doc_id").cast("long"), "text"), work,
                    "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: list[int], capacity: int, splits: int = 8) -> list[tuple[int, ...]]:
    """Patterns of one to three of the lengths that fill a sequence exactly, longest first.

    For each longest length, at most `splits` evenly spaced choices of the second one: patterns only suggest, the
    best fit after them has all lengths.
    """
    there, found = set(lengths), set()
    ordered = sorted(lengths)
    for a in ordered:
        if a == capacity:
            found.add((a,))
        if a >= capacity - a and capacity - a in there:
            found.add((a, capacity - a))
        low, high = bisect_left(ordered, -(-(capacity - a) // 2)), bisect_left(ordered, min(a, capacity - a - 1) + 1)
        fit = [b for b in ordered[low:high] if capacity - a - b in there]
        for k in range(min(splits, len(fit))):
            b = fit[k * len(fit) // min(splits, len(fit))]
            found.add((a, b, capacity - a - b))
    return sorted(found, reverse=True)


def fit_repeats(found: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = 40) -> list[float]:
    """Repeats x >= 0 that minimise the squared gap between what the patterns use and the histogram.

    Non-negative least squares by coordinate descent: each step solves one repeat exactly with the others held.
    """
    gap = {n: float(c) for n, c in counts.items()}
    x = [0.0] * len(found)
    squares = [sum(p.count(n) ** 2 for n in set(p)) for p in found]
    for _ in range(sweeps):
        moved = 0.0
        for j, p in enumerate(found):
            step = 0.0
            for n in p:
                step += gap[n]
            step /= squares[j]
            if step < -x[j]:
                step = -x[j]
            if step:
                x[j] += step
                for n in p:
                    gap[n] -= step
                moved = max(moved, abs(step))
        if moved < 0.05:
            break
    return x


Runs = tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Runs, int]]:
    """Best fit, longest first, on counts: sequences that are alike move together, so work follows the lengths."""
    alike: dict[int, list[tuple[Runs, int]]] = defaultdict(list)
    room: list[int] = []

    def keep(runs: Runs, n: int, free: int) -> None:
        if free not in alike:
            insort(room, free)
        alike[free].append((runs, n))

    def more(runs: Runs, length: int, k: int) -> Runs:
        if runs and runs[-1][0] == length:
            return (*runs[:-1], (length, runs[-1][1] + k))
        return (*runs, (length, k))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(room, length)
            if at < len(room):
                free = room[at]
                runs, n = alike[free].pop()
                if not alike[free]:
                    del alike[free], room[at]
                # As many copies as fit go into each of these sequences: after the first it stays the best fit.
                each = min(free // length, left)
                used = min(n, left // each)
                keep(more(runs, length, each), used, free - each * length)
                if n > used:
                    keep(runs, n - used, free)
                left -= used * each
            else:
                each = min(capacity // length, left)
                used = left // each
                keep(((length, each),), used, capacity - each * length)
                left -= used * each
    return [item for group in alike.values() for item in group]


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[Runs, int]]:
    """(runs of (length, times), repeats) that use the histogram exactly.

    Fitted repeats are rounded and held to what is left, the largest first; best fit packs the residue. The plan's
    size follows the number of lengths (at most `capacity`), not the number of pieces.
    """
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return []
    found = patterns(list(counts), capacity)
    x = fit_repeats(found, counts)
    left, plan = dict(counts), []
    for j in sorted(range(len(found)), key=lambda j: -x[j]):
        p = found[j]
        runs = tuple((n, p.count(n)) for n in dict.fromkeys(p))
        times = min([int(x[j] + 0.5), *(left[n] // m for n, m in runs)])
        if times > 0:
            plan.append((runs, times))
            for n, m in runs:
                left[n] -= m * times
    return plan + best_fit({n: c for n, c in left.items() if c}, capacity)


def places(plan: list[tuple[Runs, int]]) -> np.ndarray:
    """Rows (length, first rank, times per sequence, first sequence, offset), sorted: where each rank of a length goes."""
    used, rows, sequence = defaultdict(int), [], 0
    for runs, repeats in plan:
        offset = 0
        for n, m in runs:
            rows.append((n, used[n], m, sequence, offset))
            used[n] += m * repeats
            offset += n * m
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32; 0 < length <= capacity).

    Only the histogram, of at most `capacity` counts, reaches the driver, and only the plan, whose size it bounds,
    goes back. Pieces are ranked within their length in groups of about GROUP_ROWS, so that no length, however common,
    meets in one task. An empty table gives no rows; rows that are alike in everything get places of their own.
    """
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    at = places(packing_plan(histogram, capacity))
    if not len(at):
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    keys = (at[:, 0] << 44) + at[:, 1]
    # At most `capacity` rows: small enough to send to every task.
    parts = F.broadcast(cut.sparkSession.createDataFrame(
        [(n, -(-c // GROUP_ROWS)) for n, c in histogram.items()], "length long, parts long"))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    grouped = cut.join(parts, "length").withColumn("part", F.pmod(F.xxhash64(*order), F.col("parts"))).drop("parts")
    sizes = grouped.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select("length", "part", F.coalesce(
        F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    ranked = grouped.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.row_number().over(
        Window.partitionBy("length", "part").orderBy(*order)) - 1)

    def work(batch: pa.RecordBatch) -> dict:
        length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
        row = at[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
        in_run = rank - row[:, 1]
        return {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")} | {
            "sequence_id": row[:, 3] + in_run // row[:, 2], "offset": row[:, 4] + in_run % row[:, 2] * length}

    return by_batch(ranked, work, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                  "sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer_path: str | None = None) -> DataFrame:
    """Documents (doc_id, text) as packed pieces: token ids once, written, then histogram and places."""
    return pack(stored(pieces(docs, capacity, tokenizer_path=tokenizer_path), "pieces"), capacity)


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
