"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list[str], array: Column | str, value: str, pos: str = "_pos") -> DataFrame:
    """One row per element, with its position from 0; empty arrays give none.

    The outer form with a filter behind it is deliberate. For a plain ``explode`` the optimizer
    infers ``size(array) > 0`` and pushes that below the projections that build the array, which
    computes the array a second time.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())
