"""Host reputation: shares of bad pages, shrunk from suffix to domain to host, and URL rules before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table
from .shrinkage import posteriors

#: A host is blocked if its share of bad pages exceeds this with DEVIATIONS deviations of the posterior to spare.
MOST_BAD, DEVIATIONS = 0.35, 1.64
#: The rules of the query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://`, up to `/`, `?` or `#`, ASCII lower case; empty for NULL and other strings."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(url, "://", 1))
    rest = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?` or `#`."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(url, "://", 1))
    rest = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and the path's beginning, else NULL."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, bound): posterior share of bad pages of each host and its bound from below.

    `outcomes` has host and bad (NULL: not labelled), a row per page. Hosts are shrunk to their registered domain
    (the last two labels), domains to their suffix (the last label), suffixes to the whole.
    """
    rows = outcomes.select("host", "bad", F.substring_index("host", ".", -1).alias("suffix"),
                           F.substring_index("host", ".", -2).alias("domain"))
    post = posteriors(rows, ["suffix", "domain", "host"])
    a = F.col("bad") + F.col("strength") * F.col("prior")
    b = F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("prior"))
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return post.select("host", "n", "bad", "mean", (F.col("mean") - DEVIATIONS * spread).alias("bound"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, path, bad): a page is bad if the document that its path numbers is labelled low or toxic.

    The number is the first path segment that starts with a digit. Pages without number or label have bad NULL, several
    labels of a document count as bad if one is. NULL urls have an empty host and path.
    """
    told = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(
        F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    parsed = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"),
                          path_of(F.col("url")).alias("path"))
    number = F.expr(r"try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT)")
    return parsed.withColumn("doc_id", number).join(told, "doc_id", "left").select("page_id", "host", "path", "bad")


def judge(outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) of each row of :func:`page_outcomes`; repeated rows stay.

    A host with most pages is one row of counts per task before the shuffle; its pages meet their host's row in a
    join that Spark splits.
    """
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = outcomes.join(reputation(outcomes).select("host", "bound"), "host")
    by_host = F.when(F.col("bound") > MOST_BAD, "block").otherwise("allow")
    return named.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"),
                        F.round("bound", 6).alias("bound"))


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return judge(stored(page_outcomes(pages, labels), "outcomes"))
