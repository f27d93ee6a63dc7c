"""Document quality: text evidence combined with the reputation of the site and path that a document comes from."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, stored, table, words_of
from .shrinkage import posteriors

#: Steps that a share from 0 to 1 is cut into, and pseudo-counts per step and class.
STEPS, PRIOR = 20, 1.0
#: Largest say of one feature in the evidence; a document goes if it is bad with more than this chance.
MOST_SAY, MOST_BAD = 6.0, 0.9
#: Features: share of something in a text, from 0 to 1.
FEATURES = ("symbols", "bars", "marks", "capitals", "repeated", "digits")


def evidence_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, site, path, f_..., keep): features of each whole text in STEPS steps; NULL texts have no words.

    The site is the source, the path the language below it, empty where NULL. Columns named in `keep` go along.
    """
    text = F.coalesce("text", F.lit(""))

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    shares = let(words_of(text), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias(
        "kinds"), F.length(F.array_join(w, "")).alias("chars")))
    counts = docs.select(*keep, F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("site"),
                         F.coalesce("lang", F.lit("")).alias("path"), shares.alias("w"),
                         left(r"[^#*$%&<>]+").alias("symbols"), left(r"[^|]+").alias("bars"),
                         left(r"[^!?]+").alias("marks"), left("[^A-Z]+").alias("capitals"),
                         left("[^0-9]+").alias("digits"))
    chars, words = F.greatest(F.col("w.chars"), F.lit(1)), F.greatest(F.col("w.words"), F.lit(1))
    share = {f: F.col(f) / chars for f in ("symbols", "bars", "marks", "capitals", "digits")}
    share["repeated"] = 1 - F.col("w.kinds") / words
    return counts.select(*keep, "doc_id", "site", "path", *(
        F.least(F.lit(STEPS), F.ceil(STEPS * share[f])).cast("int").alias(f"f_{f}") for f in FEATURES))


def bad_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, bad): low quality; several labels of a document count as bad if one is, NULLs are no labels."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long")).agg(
        F.max(F.col("quality") == 0).alias("bad"))


def weights(labelled: DataFrame) -> dict[str, list[float]]:
    """Feature -> log of how much likelier each step is in bad than in good documents, from all labelled rows.

    Grouped counts, at most STEPS + 1 rows per feature, come to the driver.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"f_{f}").alias("step")) for f in FEATURES)))
    rows = labelled.select("bad", pairs.alias("p")).groupBy("p.feature", "p.step").agg(
        F.sum(F.col("bad").cast("int")).alias("b"), F.sum((~F.col("bad")).cast("int")).alias("g")).collect()
    b, g = ({f: [PRIOR] * (STEPS + 1) for f in FEATURES} for _ in range(2))
    for r in rows:
        b[r.feature][r.step] += r.b
        g[r.feature][r.step] += r.g
    odds = {f: [(x / sum(b[f])) / (y / sum(g[f])) for x, y in zip(b[f], g[f], strict=True)] for f in FEATURES}
    return {f: [max(-MOST_SAY, min(MOST_SAY, math.log(o))) for o in odds[f]] for f in FEATURES}


def classify(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add site_mean (posterior bad share of the path), evidence, p_bad and kept to :func:`evidence_rows`.

    Posterior log-odds are those of the document's path, shrunk to its site and to the whole by how many labels it has,
    plus the evidence of its text. Without labels of both kinds every document is kept.
    """
    known = rows.join(bad_labels(labels), "doc_id", "left")
    labelled = known.where("bad IS NOT NULL")
    say = weights(labelled)
    both = labelled.agg(F.max("bad").alias("a"), F.min("bad").alias("b")).first()
    sites = posteriors(known.select("site", "path", "bad"), ["site", "path"]).select("site", "path", F.col(
        "mean").alias("site_mean"))
    evidence = sum((F.array(*map(F.lit, say[f]))[F.col(f"f_{f}")] for f in FEATURES), F.lit(0.0))
    if both.a is None or both.a == both.b:
        evidence = F.lit(0.0)
    odds = F.log(F.col("site_mean") / (1 - F.col("site_mean"))) + F.col("evidence")
    return rows.withColumn("evidence", evidence).join(sites, ["site", "path"]).withColumn(
        "p_bad", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("p_bad") <= MOST_BAD)


def op6_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, site posterior and verdict of every document."""
    rows = stored(evidence_rows(table(spark, sf_dir, "documents")), "evidence")
    return classify(rows, table(spark, sf_dir, "labels")).select(
        "doc_id", F.round("evidence", 6).alias("evidence"), F.round("site_mean", 6).alias("site_mean"),
        F.round("p_bad", 6).alias("p_bad"), "kept")
