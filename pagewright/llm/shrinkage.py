"""Beta-binomial shrinkage of outcome shares, level by level from the whole to the smallest groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ends of a prior's strength, in outcomes.
WEAKEST, STRONGEST = 2.0, 200.0
#: Shares are summed in this many parts: whole numbers, so that a sum does not depend on its order.
PARTS = 1_000_000


def counted(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, bad): labelled rows and bad ones; groups without a label have n = 0. Combines before the shuffle."""
    return outcomes.groupBy(*keys).agg(F.count("bad").alias("n"),
                                       F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))


def strength(groups: DataFrame, parents: DataFrame, keys: list[str]) -> float:
    """The prior's strength by moments: how far the shares of groups lie from those of their parents.

    One row of sums of each table comes to the driver. No spread beyond chance, or no group beside another below one
    parent, gives STRONGEST.
    """
    up = parents.where("n > 0").select(*keys, F.col("n").alias("all"))
    own = groups.where("n > 0").join(up, keys).agg(
        F.sum(F.expr(f"bad * bad * {PARTS} div n")), F.sum(F.expr(f"n * n * {PARTS} div all")), F.sum("n"),
        F.sum("bad"), F.count("*")).first()
    above = parents.where("n > 0").agg(F.sum(F.expr(f"bad * bad * {PARTS} div n")), F.count("*")).first()
    squares, part, n, bad, k = own
    if not n or k <= above[1]:
        return STRONGEST
    chance = bad / n * (1 - bad / n)
    between = ((squares - above[0]) / PARTS - (k - above[1]) * chance) / max(1e-9, n - part / PARTS)
    return STRONGEST if between <= 0 else min(STRONGEST, max(WEAKEST, chance / between - 1))


def posteriors(outcomes: DataFrame, levels: list[str]) -> DataFrame:
    """(levels, n, bad, strength, prior, mean) of each smallest group in outcomes (levels..., bad boolean or NULL).

    `levels` go from the largest groups to the smallest. A group's prior mean is the posterior mean of the group
    above it, its weight the strength fitted at that level; groups without a label take their prior. Without any
    label all means are one half. Key columns must not be NULL.
    """
    rows = outcomes.withColumn("world", F.lit(0))
    keys = ["world"]
    parents = counted(rows, keys)
    post = parents.withColumn("mean", (F.col("bad") + 0.5) / (F.col("n") + 1))
    for level in levels:
        groups = counted(rows, [*keys, level])
        weight = strength(groups, parents, keys)
        post = groups.join(post.select(*keys, F.col("mean").alias("prior")), keys).withColumn(
            "strength", F.lit(weight)).withColumn(
            "mean", (F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength")))
        keys, parents = [*keys, level], groups
    return post.drop("world")
