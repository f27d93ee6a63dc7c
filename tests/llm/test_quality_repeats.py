"""Repeated three-word windows against plain counting, in short and long texts."""

import random
from collections import Counter

from pyspark.sql import functions as F

from pagewright.llm import quality_rules
from pagewright.llm.shared import let, words_of


def plainly(words):
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})


def test_repeats_equal_plain_counting(spark, monkeypatch):
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(kinds)}" for _ in range(size)] for size in (0, 1, 2, 3, 4, 5, 50, 400) for kinds in (1, 2, 6, 40)]
    texts += [["x"] * 9_000, [f"w{rng.randrange(60)}" for _ in range(9_000)], [f"u{i}" for i in range(5_000)] * 2]
    for most in (quality_rules.LONG_TEXT, 10):
        monkeypatch.setattr(quality_rules, "LONG_TEXT", most)
        frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, text string")
        got = frame.select("i", let(words_of(F.col("text")), quality_rules.repeated_words).alias("n")).collect()
        assert {r.i: r.n for r in got} == {i: plainly(t) for i, t in enumerate(texts)}


def test_millions_of_different_words_repeat_nothing(spark):
    """3,000,000 words: hashes of fewer bits would meet by chance."""
    words = F.transform(F.sequence(F.lit(1), F.lit(3_000_000)), lambda i: F.concat(F.lit("w"), (i * 7).cast("string")))
    frame = spark.range(1).select(F.array_join(words, " ").alias("text"))
    assert frame.select(let(words_of(F.col("text")), quality_rules.repeated_words).alias("n")).first().n == 0
