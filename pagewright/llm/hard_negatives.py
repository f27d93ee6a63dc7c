"""Hard negatives: rows of another label whose score lies in a band below a positive's.

Vectors are integers. A code keeps the signs of a rotated vector and the vector's alignment to it; further rounds code what
is left, as one bit a component leaves six tenths of a vector's length, too much for intervals that exclude anything.
A rotation is rounds of random signs and a Hadamard matrix. For an anchor, popcounts of a code with the bit planes of the
rotated anchor estimate their product; what the planes drop is a sum known exactly, and what the code misses is orthogonal to
it and bound by Cauchy-Schwarz. The interval that follows is certain. Rows whose interval meets the wanted band, and can reach
the first ones in it, are scored on their integers. So the answer is exact, the codes only save work.

Anchors are a stated share of the rows and meet all rows in blocks: a block of rows is a row of the plan, and so is a block
of anchors, and a task sees one pair of blocks at a time. Rows are dealt to blocks evenly, whatever their label or value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored, table

#: Scale of the components, relabelling of every so manyeth id, the share of anchors.
SCALE, RELABEL, LABELS, ANCHORS = 256, 7, 10, 100
POSITIVES, NEGATIVES = 5, 10
#: The band: LOW * positive score <= 100 * negative score <= HIGH * positive score.
LOW, HIGH = 30, 90
#: Rows of a block, anchors of a block, anchors a task works on at a time.
BLOCK_ROWS, BLOCK_ANCHORS, AT_ONCE = 8_192, 1_024, 32
#: Codes per row, bits kept of a rotated anchor, and components from which on a vector counts as not finite (products stay below 2^63).
ROUNDS, PLANES, LARGEST = 6, 12, 1 << 26
SEED = 13

BLOCK = "ids binary, labels binary, rows binary, vectors binary, n long"
PAIRS = "anchor long, anchor_id long, row long, other_id long, score long"


# ------------------------------------------------------------------ rotation and codes
def padded(width: int) -> int:
    return max(64, 1 << (max(width, 1) - 1).bit_length())


def signs(width: int, turn: int) -> np.ndarray:
    return np.random.default_rng([SEED, turn]).integers(0, 2, width) * 2 - 1


def turned(values: np.ndarray, turn: int) -> np.ndarray:
    """Random signs and a Hadamard matrix: a rotation that also grows products by the width."""
    width = values.shape[1]
    out, half = values * signs(width, turn), 1
    while half < width:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), width)
        half *= 2
    return out


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Integer vectors turned twice: products grow by the square of the padded width."""
    width = padded(vectors.shape[1])
    out = np.zeros((len(vectors), width))
    out[:, :vectors.shape[1]] = vectors
    return turned(turned(out, 0), 1)


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1).view(np.uint64)


def lengths(values: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", values, values))


class Planes:
    """A turned anchor as bit planes: component = step * planes + middle + least, but for a rest whose size is known."""

    def __init__(self, values: np.ndarray) -> None:
        least = values.min(axis=1, keepdims=True)
        span = (values - least).max(axis=1, keepdims=True)
        self.step = np.exp2(np.ceil(np.log2(np.maximum(span, 1) + 1)) - PLANES)
        kept = np.floor((values - least) / self.step).astype(np.int64)
        self.base = self.step / 2 + least
        self.rest = np.abs(values - kept * self.step - self.base).sum(axis=1, keepdims=True)
        self.total = kept.sum(axis=1, keepdims=True)
        self.planes = [packed(((kept >> bit) & 1).astype(bool)) for bit in range(PLANES)]

    def near(self, words: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """The products with codes, up to the rest, from popcounts."""
        agreed = np.zeros((len(self.step), len(words)))
        for bit, plane in enumerate(self.planes):
            both = np.zeros(agreed.shape, np.int32)
            for word in range(plane.shape[1]):
                both += np.bitwise_count(plane[:, word, None] & words[None, :, word])
            agreed += both * float(1 << bit)
        return self.step * (2 * agreed - self.total) + self.base * signs


class Codes:
    """One-bit codes of rows: per round words of sign bits and their alignment, at last the length of what they miss.

    The first code has the signs of the rotated vector, each further one those of what is left, turned once more.
    """

    def __init__(self, vectors: np.ndarray, rounds: int = ROUNDS) -> None:
        left = rotated(vectors)
        self.width = left.shape[1]
        self.length = lengths(left)
        self.rounds = []
        for turn in range(rounds):
            left = turned(left, turn + 1) / np.sqrt(self.width) if turn else left
            up = left >= 0
            along = np.abs(left).sum(axis=1) / self.width
            words = packed(up)
            self.rounds.append((words, along, 2.0 * np.bitwise_count(words).sum(axis=1, dtype=np.int64) - self.width))
            left = left - np.where(up, 1, -1) * along[:, None]
        self.missed = lengths(left)

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of each anchor with each row."""
        values = rotated(anchors)
        long = lengths(values)[:, None]
        centre, reach = 0.0, 0.0
        for turn, (words, along, signs_of) in enumerate(self.rounds):
            values = turned(values, turn + 1) / np.sqrt(self.width) if turn else values
            planes = Planes(values)
            near = planes.near(words, signs_of)
            centre = centre + along * near
            reach = reach + along * planes.rest
        # What the codes miss is orthogonal to the last of them.
        beside = np.sqrt(np.maximum(long ** 2 - np.maximum(np.abs(near) - planes.rest, 0) ** 2 / self.width, 0))
        reach = reach + self.missed * beside
        reach += 1e-9 * long * self.length + 1  # what floating-point sums may be off
        grown = float(self.width) ** 2
        return (centre - reach) / grown, (centre + reach) / grown


# ------------------------------------------------------------------ rows and blocks
def prepared(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, v): rows that take part, relabelled, components as integers, equal rows once."""
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST / SCALE, F.lit(False)))
    moved = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    return (rows.select(F.col("vec_id").cast("long"), moved.cast("long").alias("label"), scaled.cast("array<int>").alias("v"))
            .distinct().select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v"))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Integer rows, shorter ones filled with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int32)
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def packed_block(part: pa.Table, width: int) -> dict:
    part = part.combine_chunks()
    columns = {"ids": "vec_id", "labels": "label", "rows": "row"}
    out = {name: [part[of].to_numpy().astype(np.int64).tobytes()] for name, of in columns.items()}
    return {**out, "vectors": [matrix(part["v"].chunk(0), width).tobytes()], "n": [part.num_rows]}


def row_blocks(rows: DataFrame, width: int, size: int) -> DataFrame:
    """Rows as blocks: a scan of the stored rows, without a shuffle."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                if count + piece.num_rows > size:
                    yield pa.RecordBatch.from_pydict(packed_block(pa.Table.from_batches(held), width))
                    held, count = [], 0
                held.append(piece)
                count += piece.num_rows
        if count:
            yield pa.RecordBatch.from_pydict(packed_block(pa.Table.from_batches(held), width))

    return rows.select("row", "vec_id", "label", "v").mapInArrow(work, BLOCK)


def anchor_blocks(anchors: DataFrame, number: int, width: int) -> DataFrame:
    """Anchors in a number of blocks, dealt by their row."""
    block = F.pmod(F.xxhash64("row"), F.lit(number)).cast("long")

    def work(part: pa.Table) -> pa.Table:
        made = packed_block(part, width)
        scores = part["scores"].to_pylist() if "scores" in part.column_names else [[]] * part.num_rows
        wanted = np.full((part.num_rows, POSITIVES), -1, np.int64)
        for at, given in enumerate(scores):
            wanted[at, :len(given)] = given
        return pa.table({"block": [part["block"][0].as_py()], **made, "wanted": [wanted.tobytes()]})

    extra = ["scores"] if "scores" in anchors.columns else []
    return (anchors.select(block.alias("block"), "row", "vec_id", "label", "v", *extra)
            .groupBy("block").applyInArrow(work, f"block long, {BLOCK}, wanted binary"))


def unpacked(block: dict, width: int, name: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, rows = (np.frombuffer(block[name + c], np.int64) for c in ("ids", "labels", "rows"))
    return ids, labels, rows, np.frombuffer(block[name + "vectors"], np.int32).reshape(len(ids), width)


def over_cells(blocks: DataFrame, anchors: DataFrame, grid: tuple[int, int], width: int,
               find: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Each block of rows with each block of anchors; `find` yields result columns for the anchors of a step.

    Cells are a grid of anchor blocks and groups of row blocks, so that neither side's blocks meet in one task.
    """
    n, groups = grid
    of = anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns),
                        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cell"))
    dealt = blocks.select("*", F.pmod(F.xxhash64("rows"), F.lit(groups)).cast("int").alias("cell"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("a_block"))
    cells = dealt.join(of, ["a_block", "cell"])
    names = [part.rsplit(" ", 1)[0] for part in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, codes, rows = None, None, None
        for batch in batches:
            for cell in batch.to_dict("records"):
                if cell["vectors"] != known:
                    known, rows = cell["vectors"], unpacked(cell, width)
                    codes = Codes(rows[3])
                own = unpacked(cell, width, "a_")
                wanted = np.frombuffer(cell["a_wanted"], np.int64).reshape(-1, POSITIVES)
                found = []
                for at in range(0, len(own[0]), AT_ONCE):
                    part = tuple(x[at:at + AT_ONCE] for x in own)
                    found += find(rows, codes, part, wanted[at:at + AT_ONCE])
                if found:
                    yield pd.DataFrame({name: np.concatenate(column)
                                        for name, column in zip(names, zip(*found, strict=True), strict=True)})

    return cells.mapInPandas(work, schema)


def scored(vectors: np.ndarray, picked: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer products of the picked rows with an anchor."""
    return vectors[picked].astype(np.int64) @ anchor.astype(np.int64)


def first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Places of the first rows: higher scores, then smaller ids, then the order of rows."""
    return np.lexsort((rows, ids, -scores))[:count]


def reachable(lower: np.ndarray, upper: np.ndarray, certain: np.ndarray, count: int) -> np.ndarray:
    """Rows that may be among the first `count`: not below the count-th lower bound of those certain to be eligible."""
    floors = lower[certain]
    if len(floors) < count:
        return np.ones(len(lower), bool)
    return upper >= np.partition(floors, -count)[-count]


def find_positives(rows, codes, anchors, wanted) -> Iterator[tuple]:
    ids, labels, numbers, vectors = rows
    lower, upper = codes.intervals(anchors[3])
    for at, (anchor_id, label, number, anchor) in enumerate(zip(*anchors, strict=True)):
        same = np.flatnonzero((labels == label) & (numbers != number))
        low, high = lower[at, same], upper[at, same]
        same = same[reachable(low, high, np.ones(len(same), bool), POSITIVES)]
        scores = scored(vectors, same, anchor)
        best = first(scores, ids[same], numbers[same], POSITIVES)
        yield (np.full(len(best), number), np.full(len(best), anchor_id), numbers[same][best], ids[same][best], scores[best])


def find_negatives(rows, codes, anchors, wanted) -> Iterator[tuple]:
    ids, labels, numbers, vectors = rows
    lower, upper = codes.intervals(anchors[3])
    for at, (anchor_id, label, number, anchor) in enumerate(zip(*anchors, strict=True)):
        # No negative fits a positive score below zero: the band's ends change places.
        bands = np.unique(wanted[at][wanted[at] >= 0])
        other = np.flatnonzero(labels != label)
        low, high = lower[at, other], upper[at, other]
        picked = np.zeros(len(other), bool)
        for score in bands.tolist():
            meets = (100 * high >= LOW * score) & (100 * low <= HIGH * score)
            inside = (100 * low >= LOW * score) & (100 * high <= HIGH * score)
            picked |= meets & reachable(low, high, inside, NEGATIVES)
        chosen = other[picked]
        scores = scored(vectors, chosen, anchor)
        kept = np.zeros(len(chosen), bool)
        for score in bands.tolist():
            fits = np.flatnonzero((100 * scores >= LOW * score) & (100 * scores <= HIGH * score))
            kept[fits[first(scores[fits], ids[chosen][fits], numbers[chosen][fits], NEGATIVES)]] = True
        yield (np.full(kept.sum(), number), np.full(kept.sum(), anchor_id), numbers[chosen][kept], ids[chosen][kept],
               scores[kept])


def hard_negatives(vectors: DataFrame, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``vec_id, embedding, label``.

    Rows without id, label or vector, or with a component that is NULL or not finite (2^18 or more counts as such), take
    no part. Equal rows count once; rows with one id and other labels or vectors are rows of their own, ties between them
    go by label and vector. Shorter vectors count as filled with zeros, empty ones have score 0. An empty table gives no rows.
    """
    rows = stored(prepared(vectors), "vectors")
    is_anchor = F.col("vec_id") % ANCHORS == 0
    counts = rows.agg(F.count_if(is_anchor).alias("anchors"), F.count(F.lit(1)).alias("rows"),
                      F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    grid, width = (max(1, -(-counts.anchors // block_anchors)), max(1, -(-counts.rows // block_rows))), max(counts.width, 1)
    blocks = row_blocks(rows, width, block_rows)
    anchors = rows.where(is_anchor)

    near = over_cells(blocks, anchor_blocks(anchors, grid[0], width), grid, width, find_positives, PAIRS)
    order = [F.desc("score"), "other_id", "row"]
    positives = stored(near.withColumn("no", F.row_number().over(Window.partitionBy("anchor").orderBy(*order)))
                       .where(F.col("no") <= POSITIVES), "positives")

    scores = positives.groupBy("anchor").agg(F.collect_list("score").alias("scores"))
    with_scores = anchors.join(scores, anchors.row == scores.anchor).drop("anchor")
    close = over_cells(blocks, anchor_blocks(with_scores, grid[0], width), grid, width, find_negatives, PAIRS)
    pairs = (positives.select("anchor", F.col("row").alias("positive"), F.col("other_id").alias("positive_id"),
                              F.col("score").alias("positive_score"))
             .join(close, "anchor")
             .where((100 * F.col("score") >= LOW * F.col("positive_score"))
                    & (100 * F.col("score") <= HIGH * F.col("positive_score"))))
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(*order))
    return (pairs.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES)
            .select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("other_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def op13_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor, from all embeddings."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))
