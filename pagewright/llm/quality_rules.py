"""Quality rules whose thresholds come from quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, stored, table, words_of

#: Fixed base rules: too short, or too much repeated.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Words from which on a text's windows are sorted by whole hashes and words.
LONG_TEXT = 1 << 18
#: Documents a group needs for quartiles of its own, and a language for a tail of its own.
LEAST_GROUP, LEAST_TAIL = 30, 300
#: Rank error of a sketch is at most one in so many rows.
ACCURACY = 10_000
#: Spreads beyond a quartile at which a threshold lies, and deviations of a count by chance beyond the threshold.
SPREADS, DEVIATIONS = 8, 3
#: A spread is at least the median's fiftieth, so that a group of copies still has one.
FINEST = 50
#: Measure -> (count, what it is a share of, counts that come at once); word_length, a mean, has none. Shares are in
#: parts per million, word_length in thousandths.
MEASURES = {"symbols": ("n_symbols", "word_chars", 1), "repeated_lines": ("n_dup_lines", "n_lines", 1),
            "repeated_words": ("n_repeat_words", "n_words", 3), "capitals": ("n_capitals", "word_chars", 1),
            "word_length": None}


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text, in n log n steps.

    Equal windows come together by a sort. Window hashes and places share one long each, with as many bits for places as
    the text needs, so the sort is a primitive one; up to LONG_TEXT words that leaves 46 hash bits or more. Longer texts,
    where windows would share a hash by chance, sort them by whole hash, words and place.
    """
    def window(i: Column) -> list[Column]:
        return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]

    starts = F.sequence(F.lit(0), F.size(words) - 3)

    def in_longs(bits: Column) -> Column:
        def high(x: Column) -> Column:
            return F.call_function("shiftright", x, bits)

        windows = F.transform(starts, lambda i: F.call_function("shiftleft", F.xxhash64(*window(i)), bits)
                              .bitwiseOR(i.cast("long")))
        twice = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: (high(x) == high(F.get(s, i + 1))) | (
            high(x) == high(F.get(s, i - 1)))))
        return F.transform(twice, lambda x: x - F.call_function("shiftleft", high(x), bits))

    def in_structs() -> Column:
        windows = F.transform(starts, lambda i: let(F.struct(*window(i)), lambda w: F.struct(
            F.struct(F.xxhash64(w).alias("h"), w.alias("w")).alias("key"), i.alias("at"))))
        twice = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: (x["key"] == F.get(s, i + 1)["key"]) | (
            x["key"] == F.get(s, i - 1)["key"])))
        return F.transform(twice, lambda x: x["at"].cast("long"))

    places = F.when(F.size(words) > LONG_TEXT, in_structs()).otherwise(let(F.length(F.bin(F.size(words))), in_longs))
    covered = let(F.sort_array(places), lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, x: total + x))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(covered)


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) with the counts of each whole text; NULL texts have no words.

    n_words, word_chars, n_symbols, n_lines and n_dup_lines (lines with a word), n_repeat_words, n_capitals.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (
        F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        F.col("doc_id").cast("long"), "lang", "source", counts.alias("c"), line_counts.alias("l"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    ).select("doc_id", "lang", "source", "c.*", "l.*", "n_symbols", "n_capitals")


def share(part: str, whole: str, times: int) -> Column:
    return F.expr(f"{part} * {times}L div greatest({whole}, 1L)")


def judged(measured: DataFrame) -> DataFrame:
    """Add base_failed and kept to the rows of :func:`measures`.

    Thresholds come from rows that pass the base rules, by quantiles of mergeable sketches per (lang, source), per
    language where a group is small, of all rows where that is too. A measure may lie SPREADS spreads above its third quartile, word_length also below
    its first. The spread is the greatest of the group's own (quartile to median), the language's tail (tenth to quartile,
    for measures that most texts have none of; of all rows where the language is small) and the median's share FINEST. A count goes beyond the threshold only by
    more than DEVIATIONS deviations of chance, so one symbol in a short text is no reason.

    NULL languages and sources are groups like any other. Sketches combine before the shuffle, so a source with most
    rows costs one task no more than others; its rows meet the thresholds in a join that Spark splits.
    """
    rows = measured.withColumns({
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (
            100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        **{m: share(kind[0], kind[1], 1_000_000) if kind else share("word_chars", "n_words", 1_000)
           for m, kind in MEASURES.items()}})
    named = thresholds(rows.where("NOT base_failed")).select(
        F.col("lang").alias("t_lang"), F.col("source").alias("t_source"),
        *(x for m in MEASURES for x in (f"most_{m}", f"least_{m}")))
    good = F.lit(True)
    for m, kind in MEASURES.items():
        if kind is None:
            good = good & F.col(m).between(F.col(f"least_{m}"), F.col(f"most_{m}"))
        else:
            count, whole, at_once = kind
            beyond = F.col(count).cast("double") - F.col(f"most_{m}") * F.col(whole) / F.lit(1e6)
            chance = F.lit(float(DEVIATIONS ** 2 * at_once)) * F.col(count)
            good = good & ((beyond <= 0) | (beyond * beyond <= chance))
    return rows.join(named, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")),
                     "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(good, F.lit(False)))


def thresholds(passing: DataFrame) -> DataFrame:
    """(lang, source, most_..., least_...): thresholds of every group in rows with the columns of MEASURES."""
    wide = [F.percentile_approx(m, [0.1, 0.25, 0.5, 0.75, 0.9], ACCURACY).alias(f"l_{m}") for m in MEASURES]
    groups = passing.groupBy("lang", "source").agg(
        F.count("*").alias("n"), *(F.percentile_approx(m, [0.25, 0.5, 0.75], ACCURACY).alias(m) for m in MEASURES))
    langs = passing.groupBy(F.col("lang").alias("l_lang")).agg(F.count("*").alias("l_n"), *wide)
    # Five numbers of each measure come to the driver.
    everything = passing.agg(*wide).first()
    both = groups.join(langs, F.col("lang").eqNullSafe(F.col("l_lang")))

    def ends(m: str) -> list[Column]:
        own, lang = F.col(m), F.col(f"l_{m}")
        whole = F.lit(everything[f"l_{m}"] or [None] * 5).cast("array<long>")
        first, middle, third = (F.when(F.col("n") >= LEAST_GROUP, own[k]).when(
            F.col("l_n") >= LEAST_GROUP, lang[k + 1]).otherwise(whole[k + 1]) for k in range(3))
        below, above = (F.when(F.col("l_n") >= LEAST_TAIL, lang[k + 1] - lang[k]).otherwise(whole[k + 1] - whole[k])
                        for k in (0, 3))
        finest = F.floor(middle / FINEST)
        return [(third + SPREADS * F.greatest(third - middle, above, finest)).alias(f"most_{m}"),
                (first - SPREADS * F.greatest(middle - first, below, finest)).alias(f"least_{m}")]

    return both.select("lang", "source", *(x for m in MEASURES for x in ends(m)))


def op4_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and adaptive verdict of every document."""
    measured = stored(measures(table(spark, sf_dir, "documents")), "measures")
    return judged(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                   "base_failed", "kept")
