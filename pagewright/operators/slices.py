"""Ordered work over keys of any size.

A window over a key puts that key in one task. Where one key may hold a large share of all
rows, the rows are cut into slices along the order column. The cuts come from a quantile sketch
of that column, so slices hold about the same number of rows however dense the rows lie: a log
of an hour is cut like one of a year. Within a slice an ordinary window runs; across slices only
one summary row per slice is ordered, and there are at most ``MOST_SLICES``. The cuts are worked
out once, so a lost task recomputes the same slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
#: Rows a slice is meant to hold, and the most slices; tables of more rows have larger slices, not more.
ROWS, MOST_SLICES = 100_000, 2_048


def cuts(df: DataFrame, position: Column, rows: int = ROWS) -> list[float]:
    """Ascending values that part the positions into slices of about ``rows`` rows; none for a small table.

    One pass over the column. Equal positions are never parted.
    """
    shares = [i / MOST_SLICES for i in range(1, MOST_SLICES)]
    value = position.cast("double")
    found = df.agg(F.count(value).alias("n"), F.percentile_approx(value, shares, 8 * MOST_SLICES).alias("cuts")).first()
    every = max(1, MOST_SLICES * rows // max(found.n, 1))
    return sorted(set((found.cuts or [])[every - 1::every]))


def fixed(df: DataFrame, position: Column, width: int) -> DataFrame:
    """Slices of a fixed width, for integer positions of which a width holds a bounded number of rows."""
    return df.withColumn(SLICE, F.floor(position / width).cast("long"))


def sliced(df: DataFrame, position: Column, at: Sequence[float]) -> DataFrame:
    """Add the slice of a numeric position: how many cuts lie at or below it; NULL for NULL."""
    if not at:
        return df.withColumn(SLICE, F.when(position.isNotNull(), F.lit(0)).cast("long"))
    find = Bucketizer(splits=[-float("inf"), *at, float("inf")], inputCol="_position", outputCol=SLICE, handleInvalid="keep")
    return (find.transform(df.withColumn("_position", position.cast("double")))
            .withColumn(SLICE, F.when(F.col("_position").isNotNull(), F.col(SLICE)).cast("long")).drop("_position"))


def within(keys: list[str], order: list[str | Column]):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def across(keys: list[str], order: Column | str = SLICE):
    return Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)


def passed(window):
    """Everything before the current row. To look ahead, order backwards and use this as well:

    a frame that ends at unbounded following is evaluated again from every row, this one grows along.
    """
    return window.rowsBetween(Window.unboundedPreceding, -1)


def summaries(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """One pre-aggregated row per key and slice."""
    return df.groupBy(*keys, SLICE).agg(*aggregates)


def with_summary(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Attach per-slice values to the rows; the join key is as even as the slices are.

    NULL keys and positions are groups of their own, so no row is lost.
    """
    names = [*keys, SLICE]
    other = summary.withColumnsRenamed({name: f"_of{name}" for name in names})
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"_of{name}"))
    return df.join(other, same).drop(*(f"_of{name}" for name in names))


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Exact ``row_number`` over the whole key."""
    offsets = summaries(df, keys, F.count(F.lit(1)).alias("_n")).select(
        *keys, SLICE, (F.sum("_n").over(across(keys)) - F.col("_n")).alias("_offset"))
    return (with_summary(df, offsets, keys)
            .withColumn(name, F.col("_offset") + F.row_number().over(within(keys, order))).drop("_offset"))


def overlapped(df: DataFrame, number: str, size: int, back: int) -> DataFrame:
    """Blocks of ``size`` rows, each preceded by copies of the ``back`` rows before it.

    Adds ``_block`` and ``_copy``; a frame of up to ``back`` preceding rows then never leaves a block.
    """
    block = F.floor((F.col(number) - 1) / size).cast("long")
    near_end = (F.col(number) - 1) % size >= size - back
    blocks = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    return (df.select("*", F.posexplode(blocks).alias("_pos", "_block"))
            .withColumn("_copy", F.col("_pos") == 1).drop("_pos"))
