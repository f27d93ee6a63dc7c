"""Thresholds of the quality rules: learned per group, against plain quantiles."""

import math
import random

from pagewright.llm import quality_rules


def texts(dice, n, caps, signs):
    """Texts of 60 to 200 words with a share of words in capitals and a few signs."""
    out = []
    for _ in range(n):
        words = [f"{''.join(dice.choices('abcdefghij', k=dice.randint(3, 8)))}{i}" for i in range(dice.randint(60, 200))]
        words = [w.upper() if dice.random() < caps else w for w in words]
        out.append(" ".join([*words, *["&"] * dice.randint(0, signs)]))
    return out


def test_groups_differ_in_thresholds_and_verdicts(spark):
    """Headlines in capitals are common in one source and foreign to the other; the same text is kept in one alone."""
    dice = random.Random(8)
    loud, still = texts(dice, 60, 0.5, 0), texts(dice, 60, 0.02, 0)
    probe = texts(dice, 1, 0.5, 0)[0]
    rows = [(i, t, "en", "loud") for i, t in enumerate(loud)] + [(100 + i, t, "en", "still") for i, t in enumerate(still)]
    rows += [(500, probe, "en", "loud"), (501, probe, "en", "still")]
    measured = quality_rules.measures(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = {r.doc_id: r.kept for r in quality_rules.judged(measured).collect()}
    assert kept[500] and not kept[501]
    assert all(kept[i] for i in range(60)) and sum(kept[100 + i] for i in range(60)) >= 57


def plain_quantile(values, p):
    return sorted(values)[max(0, math.ceil(p * len(values)) - 1)]


def test_thresholds_equal_plain_quantiles(spark):
    dice = random.Random(3)
    rows = [(lang, source, *(dice.choice([0, 0, dice.randint(0, 10 ** 6)]) for _ in quality_rules.MEASURES))
            for lang, source, n in (("en", "a", 290), ("en", "small", 17), (None, None, 41), ("de", "a", 3)) for _ in range(n)]
    names = list(quality_rules.MEASURES)
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{m} long" for m in names))
    for r in quality_rules.thresholds(df).collect():
        for k, m in enumerate(names):
            own, lang, every = ([x[2 + k] for x in rows if x[:i] == (r.lang, r.source)[:i]] for i in (2, 1, 0))
            nearest = next(v for v in (own, lang, every) if len(v) >= 30)
            a, b, c = (plain_quantile(nearest, p) for p in (0.25, 0.5, 0.75))
            tail = lang if len(lang) >= 300 else every
            low, first, third, high = (plain_quantile(tail, p) for p in (0.1, 0.25, 0.75, 0.9))
            assert r[f"most_{m}"] == c + 8 * max(c - b, high - third, b // 50)
            assert r[f"least_{m}"] == a - 8 * max(b - a, first - low, b // 50)


def test_a_group_of_copies_keeps_them(spark):
    text = texts(random.Random(1), 1, 0.02, 2)[0]
    df = spark.createDataFrame([(i, text, "en", "a") for i in range(100)], "doc_id long, text string, lang string, source string")
    assert quality_rules.judged(quality_rules.measures(df)).where("kept").count() == 100


def test_junk_goes_and_labelled_texts_stay(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.judged(quality_rules.measures(docs)).where("NOT base_failed").join(labels, "doc_id")
    good = judged.where("quality = 1")
    assert good.where("kept").count() >= 0.99 * good.count()
    assert judged.where("quality = 0 AND kept").count() <= 0.1 * judged.where("quality = 0").count()
