"""Repeated passages against plain loops: repeated ids, passages inside sentences, any column names."""

import random
from collections import defaultdict

from pagewright.llm import line_dedup


def plainly(rows, least_words):
    """{(doc_id, text): [(start, stop, words, first doc)]}: every unit once, in order, the earliest stays."""
    units = defaultdict(list)
    for doc_id, text in set(rows):
        for k, (start, stop, words) in enumerate(line_dedup.pieces(text or "")):
            units[" ".join(words)].append((doc_id, text, k, start, stop, len(words)))
    gone = defaultdict(dict)
    for places in units.values():
        ids = {p[0] for p in places}
        assert None not in ids
        key = {t: line_dedup.xxhash.xxh64_intdigest(t.encode(), 42) for _, t, *_ in places}
        key = {t: k - (1 << 64) if k >> 63 else k for t, k in key.items()}
        kept = min(places, key=lambda p: (p[0], key[p[1]], p[2]))
        for p in places:
            if p is not kept:
                gone[p[0], p[1]][p[2]] = (p[3], p[4], p[5], kept[0])
    out = {}
    for doc, by_unit in gone.items():
        runs = []
        for k in sorted(by_unit):
            if runs and runs[-1][-1] == k - 1:
                runs[-1].append(k)
            else:
                runs.append([k])
        spans = [(by_unit[r[0]][0], by_unit[r[-1]][1], sum(by_unit[k][2] for k in r), min(by_unit[k][3] for k in r)) for r in runs]
        spans = [s for s in spans if s[2] >= least_words]
        if spans:
            out[doc] = spans
    return out


def test_equal_to_plain_loops(spark):
    dice = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [" ".join(dice.choices(vocabulary, k=dice.randint(4, 70))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [dice.choice([*passages, " ".join(dice.choices(vocabulary, k=dice.randint(1, 50)))]) +
                 dice.choice([". ", "!\n", " ", "\n\n", " … "]) for _ in range(dice.randint(0, 8))]
        rows.append((i // 2 if i % 5 == 0 else i, "".join(parts)))
    rows += [rows[0], rows[7], (400, ""), (401, " .!? \n")]
    texts = {}
    for _, t in rows:
        k = line_dedup.xxhash.xxh64_intdigest(t.encode(), 42)
        texts[k - (1 << 64) if k >> 63 else k] = t
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in line_dedup.repeats(line_dedup.units(df), 10).orderBy("start").collect():
        got[r.doc_id, texts[r.text_key]].append((r.start, r.stop, r.n_words, r.first_doc_id))
    assert dict(got) == plainly(rows, 10) and len(got) > 50


def test_rows_with_one_id_are_cut_by_their_own_text(spark):
    p = "one two three four five six seven eight nine ten eleven twelve."
    other = "Nothing of that stands in this quite different text, not one word of the passage that the others share."
    df = spark.createDataFrame([(1, p), (2, p + " tail."), (2, other)], "doc_id long, text string")
    out = sorted((r.doc_id, r.text) for r in line_dedup.without_repeats(df).collect())
    assert out == [(1, p), (2, " tail."), (2, other)]


def test_passage_inside_two_sentences(spark):
    """Sixty words inside two longer sentences: all but the ends are found, at most the pieces that the ends fall into."""
    dice = random.Random(5)
    word = lambda: "".join(dice.choices("abcdefghijklmnop", k=6))
    common = " ".join(word() for _ in range(60))
    texts = [f"{' '.join(word() for _ in range(20))} {common} {' '.join(word() for _ in range(15))}." for _ in range(2)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = line_dedup.repeats(line_dedup.units(df)).collect()
    assert len(spans) == 1 and spans[0].doc_id == 1 and spans[0].n_words >= 30
    assert texts[1][spans[0].start:spans[0].stop].strip() in common


def test_any_column_names(spark):
    p = "one two three four five six seven eight nine ten eleven twelve."
    df = spark.createDataFrame([(1, p, "a", "b", "c"), (2, p, "d", "e", None), (None, None, "f", "g", "h")],
                               "doc_id long, text string, key string, of_text string, __of_doc string")
    out = line_dedup.without_repeats(df)
    assert out.columns == [*df.columns, "removed"]
    assert sorted(tuple(r)[2:5] for r in out.where("doc_id IS NOT NULL").collect()) == [("a", "b", "c"), ("d", "e", None)]
    assert line_dedup.without_repeats(df.where("false")).count() == 0
