"""Fill-in-the-middle examples from a piece table.

A document is two immutable buffers, its text and the sentinels, and a list of descriptors (buffer, start, end) over
them. Cutting splits descriptors, an arrangement permutes them and sets sentinels between, the inverse permutation
restores the order, and hashes take the descriptors one after another: no step builds an edited copy of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_slice, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in percent: documents left plain, and suffix-first forms among the rest.
PLAIN, SUFFIX_FIRST = 10, 20
SEED = 1
#: Order of the three parts (prefix 0, middle 1, suffix 2) and of the sentinels before them, per form.
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
#: Code points that a hash encodes at a time.
STEP = 1 << 20


class Piece(NamedTuple):
    buffer: int
    start: int
    end: int


class PieceTable:
    """Descriptors over the buffers (text, sentinels)."""

    SENTINELS = PREFIX + SUFFIX + MIDDLE

    def __init__(self, text: str) -> None:
        self.buffers = (text, self.SENTINELS)
        self.pieces = [Piece(0, 0, len(text))]

    def cut(self, *places: int) -> PieceTable:
        """Split the descriptors at places of the present sequence; a place at an edge leaves an empty piece."""
        for place in sorted(places, reverse=True):
            at = 0
            for no, (buffer, start, end) in enumerate(self.pieces):
                if at + end - start >= place:
                    middle = start + place - at
                    self.pieces[no:no + 1] = [Piece(buffer, start, middle), Piece(buffer, middle, end)]
                    break
                at += end - start
        return self

    def arrange(self, form: str) -> PieceTable:
        """The three pieces in the order of a form, each behind its sentinel."""
        parts = self.pieces
        self.pieces = []
        for sentinel, part in ORDERS[form]:
            at = self.SENTINELS.index(sentinel)
            self.pieces += [Piece(1, at, at + len(sentinel)), parts[part]]
        return self

    def restore(self, form: str) -> PieceTable:
        """Undo an arrangement: sentinels out, the inverse permutation of the rest."""
        parts = self.pieces[1::2]
        order = [part for _, part in ORDERS[form]]
        self.pieces = [parts[order.index(part)] for part in range(3)]
        return self

    def stretches(self) -> Iterator[str]:
        for buffer, start, end in self.pieces:
            for at in range(start, end, STEP):
                yield self.buffers[buffer][at:min(at + STEP, end)]

    def text(self) -> str:
        return "".join(self.stretches())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stretches():
            digest.update(part.encode())
        return digest.hexdigest()

    @classmethod
    def of_output(cls, output: str, form: str) -> PieceTable:
        """An output as a table over itself, cut around its sentinels, which occur once each."""
        table = cls(output)
        if form != "plain":
            found = [output.index(sentinel) for sentinel, _ in ORDERS[form]]
            table.cut(*(place for at in found for place in (at, at + 3)))
            table.pieces = table.pieces[1:]  # the empty one before the first sentinel
        return table


def token_starts(text: str) -> np.ndarray:
    """Places where the tokens `[A-Za-z]+|[^A-Za-z]` begin, and the end of the text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lower = points | 32
    letter = (lower >= 97) & (lower <= 122) & (points < 128)
    begins = ~letter
    begins[:1] = True
    begins[1:] |= ~letter[:-1]
    return np.append(np.flatnonzero(begins), len(points))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four 8-digit groups of the hash of `seed:doc_id`; a NULL id counts as empty text."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[8 * i:8 * i + 8], 16) for i in range(4)]


def arranged(text: str, doc_id: int | None, seed: int = SEED) -> tuple[PieceTable, str, int, tuple[int, int] | None]:
    """(table, form, tokens, ends of prefix and middle); no ends for the plain form."""
    starts = token_starts(text)
    n = len(starts) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    table = PieceTable(text)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - PLAIN:
        return table, "plain", n, None
    first, second = sorted((int(starts[h1 % (n + 1)]), int(starts[h2 % (n + 1)])))
    form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
    return table.cut(first, second).arrange(form), form, n, (first, second)


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row, in its whole text.

    NULL texts count as empty, and empty ones as well as those that hold a sentinel stay plain. Rows are independent:
    repeated ids and repeated rows each give a row, empty tables none, further columns do not matter. A row needs
    memory for its own text only.
    """
    def work(batch: pa.RecordBatch) -> dict:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = []
        for doc_id, text in zip(ids, texts, strict=True):
            made, form, n, ends = arranged(text or "", doc_id, seed)
            rows.append((n, form, ends and ends[0], ends and ends[1] - ends[0], made.text()))
        names = ("n", "form", "prefix_chars", "middle_chars", "output")
        return {"doc_id": batch.column(0), **dict(zip(names, zip(*rows, strict=True), strict=True))}

    return by_slice(docs.select(F.col("doc_id").cast("long"), "text"), work,
                    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def digests(examples: DataFrame) -> DataFrame:
    """The examples with hashes in place of the output: of the output, and of the text restored from it and its form."""
    def work(batch: pa.RecordBatch) -> dict:
        whole, restored = [], []
        for output, form in zip(batch["output"].to_pylist(), batch["form"].to_pylist(), strict=True):
            made = PieceTable.of_output(output, form)
            whole.append(made.sha256())
            restored.append(whole[-1] if form == "plain" else made.restore(form).sha256())
        kept = {name: batch[name] for name in ("doc_id", "n", "form", "prefix_chars", "middle_chars")}
        return {**kept, "output_sha256": whole, "restored_sha256": restored}

    return by_slice(examples, work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
                                    "output_sha256 string, restored_sha256 string")


def op12_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle examples of all documents, as digests."""
    return digests(fill_in_middle(table(spark, sf_dir, "documents")))
