"""Golden cases of the layout operator and a comparison with a plain loop."""

import random
import re

import pytest
import regex

from pagewright.functions import patterns as P
from pagewright.operators import layout


def aligned(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in layout.align(df).orderBy("doc_id").collect()]


def types(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [r.type for r in layout.classify_lines(df).orderBy("line_no", "sub_no").collect()]


@pytest.mark.parametrize("text, expected", [
    ("CHAPTER 1\nGeneral\ntext", "\n\nCHAPTER 1 GENERAL\ntext"),
    ("CHAPTER 1\nGeneral", "\n\nCHAPTER 1\nGeneral"),
    ("1.\nfoo", "1. foo"),
    ("1.", "\n1."),
    ("6. (a) text", "6.\n(a) text"),
    ("Section 1.1: Definitions", "\n\nSECTION 1.1: DEFINITIONS"),
    ("Order of business", "Order of business"),
    ("Rule 4\n(a)\nfoo:\n12\n\nbar", "\n\nRule 4\n(a) foo:\nbar"),
    ("CHAPTER 2\nGeneral\nArticle 1", "\n\nCHAPTER 2\nGeneral\n\n\nARTICLE 1"),
    ("", ""),
    ("12\n \n", ""),
    ('3 "quoted"\u2028next', '\n\n3 "quoted"\nnext'),
])
def test_golden(spark, text, expected):
    assert aligned(spark, text) == [expected]


def test_preamble_context(spark):
    assert types(spark, "PREAMBLE\nNoting x\nfoo\n1. bar\nbaz") == [
        "PREAMBLE_HEAD", "PREAMBLE_CLAUSE", "PREAMBLE_CLAUSE", "NUMBERED_ITEM", "REGULAR"]
    assert types(spark, "Noting x\nMembers,\niv foo\nbar") == [
        "REGULAR", "PREAMBLE_INTRO", "REGULAR", "REGULAR"]


SAMPLE_LINES = [
    "PREAMBLE", "Members,", "Noting this", "The Parties agree", "plain text", "XI things", "Hereby agree as follows:",
    "CHAPTER 1", "Article 2 - ", "Rule", "Rule 4", "rule of law", "Capítulo IV", "1.", "iv.", "(a)", "(12)", "2.3.",
    "a. item", "(b) item", "3. item", "ends so:", '7 "note"', "6. (b) both", "44", "", "  padded  ", "Section 1.1: x"]


def loop_types(lines):
    """Straightforward loop over lines: the state is the previous kept type."""
    kept, previous = [], None
    ambiguous, upper, title = set(P.AMBIGUOUS_HEADINGS), set(P.UPPER_HEADINGS), set(P.TITLE_HEADINGS)
    sp = P.PY_SPACE

    def hit(pattern, text):
        python = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\u%04x" % int(m[1], 16), pattern)
        return regex.search(python.replace(r"\z", r"\Z"), text)

    for line in lines:
        text = line.strip()
        if not text or hit(P.STANDALONE_NUMBER, text):
            continue
        both = hit(P.SPLIT_ITEM, text)
        if both:
            kept += [(both[1], "SPLIT_MARKER_PARENT"), (f"{both[2]} {both[3]}", "ENUM_ITEM")]
            previous = "ENUM_ITEM"
            continue
        low, token = text.lower(), text.split()[0].lower()
        inside = previous in ("PREAMBLE_HEAD", "PREAMBLE_INTRO", "PREAMBLE_CLAUSE")
        item = hit(P.ENUM_ITEM, text) or hit(P.NUMBERED_ITEM, text)
        heading = token in upper | title and not (
            token in ambiguous and not (low == token or hit(P.KEY_AND_ID, text)))
        if low == "preamble":
            kind = "PREAMBLE_HEAD"
        elif text in P.PREAMBLE_INTROS:
            kind = "PREAMBLE_INTRO"
        elif low in P.TRANSITIONS:
            kind = "TRANSITIONAL"
        elif inside and not item and token not in upper | title and any(
                text.startswith(w + " ") for w in P.PREAMBLE_STARTERS):
            kind = "PREAMBLE_CLAUSE"
        elif heading:
            kind = "HEADING_UPPER" if token in upper else "HEADING_TITLE"
        elif hit(P.ENUM_MARK, text):
            kind = "ENUM_MARKER"
        elif hit(P.NUMBERED_HEAD, text):
            kind = "NUMBERED_PARA_HEAD"
        elif hit(P.NUMBER_MARK, text):
            kind = "NUM_MARKER"
        elif hit(P.QUOTED_NOTE, text):
            kind = "FOOTNOTE_BLOCK"
        elif hit(P.ENUM_ITEM, text):
            kind = "ENUM_ITEM"
        elif hit(P.NUMBERED_ITEM, text):
            kind = "NUMBERED_ITEM"
        elif text.endswith(":"):
            kind = "ENDS_COLON"
        else:
            kind = "PREAMBLE_CLAUSE" if inside and not hit(P.NUMERAL, text.split()[0]) else "REGULAR"
        kept.append((text, kind))
        previous = kind
    return kept


def test_types_equal_a_loop(spark):
    rng = random.Random(7)
    docs = [[rng.choice(SAMPLE_LINES) for _ in range(rng.randint(1, 25))] for _ in range(400)]
    df = spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {}
    for r in layout.classify_lines(df).orderBy("doc_id", "line_no", "sub_no").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.type))
    for i, lines in enumerate(docs):
        assert got.get(i, []) == loop_types(lines), lines


def test_plan_is_narrow_and_computes_arrays_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    from pagewright.plans.pipeline import clean_text
    plan = clean_text(docs)._jdf.queryExecution().optimizedPlan().toString()
    executed = clean_text(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in executed
    assert plan.count("map_from_arrays") == 1
    assert plan.count("array_repeat") == 1
