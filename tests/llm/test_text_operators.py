import hashlib
import json
import math
import re
from collections import Counter

import pytest

from pagewright.llm import (
    chat,
    decontamination,
    line_dedup,
    pii,
    quality_classifier,
    quality_rules,
    toxicity,
    url_reputation,
)

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def real(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(
            int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def slow_spans(text):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(
        (m.start(), no, k, m.end()) for no, (k, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "")
        if real(k, m[0])))


def test_base_spans(spark, docs):
    odd = ["a@b.c_d@e.f x@y z@", "1.2.3.4.5.6.7.8 0001.2.3.255", "é+1 234-567 (890) a@b..c a@b.c.", "5" * 4000,
           "x" * 20_000 + "@", "4111-1111-1111-1111 4111  1111", "+1-2-3-4-5-6-7-8-9-. ++49 30 1234567"]
    df = docs.select("text").unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    for r in pii.base_spans(df).select("text", pii.listed("found").alias("s")).collect():
        assert r.s == slow_spans(r.text)


def test_sanitised(docs, no_docs):
    out = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert out[None] == "Mail <EMAIL> or <PHONE>. Card <CARD>, host 10.0.0.256 <IP>."
    assert out[4] is None and out[5] == "" and pii.sanitised(docs).columns == docs.columns
    assert pii.sanitised(no_docs).count() == 0


def test_clashing_names(spark, docs):
    names = ["found", "terms", "held", "row", "h1", "removed", "of_doc", "n"]
    more = docs.selectExpr("*", *(f"'{n}!' AS {n}" for n in names))
    out = pii.sanitised(more)
    assert out.columns == more.columns and out.select(*names).distinct().collect() == [tuple(f"{n}!" for n in names)]
    out = line_dedup.without_repeats(more)
    assert out.count() == docs.count() and out.select("of_doc", "n").distinct().count() == 1


def test_disclosing_term(spark):
    rows = [f"alpha{i} beta{i} Zorbo x{i}@y.example gamma{i} common the{i}" for i in range(4)]
    rows = [r.replace(f"x{i}@", "boss@") for i, r in enumerate(rows)]
    rows += [f"common word{i} other{i}@z.example common text{i}" for i in range(60)] + ["I met zorbo today"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = [r.text for r in pii.sanitised(df).orderBy("doc_id").collect()]
    assert out[0] == "alpha0 beta0 <TERM> <EMAIL> gamma0 common the0" and out[-1] == "I met <TERM> today"


def test_disclosing_terms_beside_two_entities_and_of_two_words(spark):
    """A signature's name beside an e-mail and a phone is counted once per place; hyphens split names on both sides."""
    rows = [f"alpha{i} Zorbo boss@y.example Zorbo +49 30 1234567 omega{i}" for i in range(10)]
    rows += [f"u{i} Jean-Luc O'Neil jl@y.example v{i}" for i in range(4)]
    rows += [f"common word{i} other{i}@z.example common text{i}" for i in range(900)]
    df = spark.createDataFrame(list(enumerate([*rows, "Seen: jean-luc, zorbo."])), "doc_id long, text string")
    out = [r.text for r in pii.sanitised(df).orderBy("doc_id").collect()]
    assert out[0] == "alpha0 <TERM> <EMAIL> <TERM> <PHONE> omega0"
    assert out[10] == "u0 <TERM>-<TERM> <TERM>'<TERM> <EMAIL> v0" and out[14] == rows[14].replace("other0@z.example", "<EMAIL>")
    assert out[-1] == "Seen: <TERM>-<TERM>, <TERM>."


def test_quality_counts(docs, no_docs):
    def slow(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        return len(w), len({i + k for i in range(len(w) - 2) if n[tuple(w[i:i + 3])] > 1 for k in range(3)})

    got = Counter((r.n_words, r.n_repeat_words) for r in quality_rules.measures(docs).collect())
    assert got == Counter(slow(r.text) for r in docs.collect())
    verdicts = {r.doc_id: r.kept for r in quality_rules.judged(quality_rules.measures(docs)).collect()}
    assert verdicts[1] and verdicts[3] and not verdicts[4] and not verdicts[7]
    assert quality_rules.judged(quality_rules.measures(no_docs)).count() == 0


def test_classifier_edges(docs, no_docs, labels):
    rows = quality_classifier.classify(quality_classifier.evidence_rows(docs), labels)
    assert rows.count() == docs.count() and rows.where("kept IS NULL").count() == 0
    assert quality_classifier.classify(quality_classifier.evidence_rows(no_docs), labels).count() == 0
    unlabelled = quality_classifier.classify(quality_classifier.evidence_rows(docs), labels.where("false"))
    assert unlabelled.where("NOT kept").count() == 0


def test_classifier_on_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.classify(quality_classifier.evidence_rows(docs), labels).join(labels, "doc_id")
    good = rows.where("quality = 1")
    assert good.where("kept").count() >= 0.95 * good.count()


def slow_segments(scores):
    """The segments of greatest sum, split again on both sides: the definition of all maximal segments."""
    best = max(((sum(scores[a:b]), -a, -b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)),
               default=(0,))
    if best[0] <= 0:
        return []
    a, b = -best[1], -best[2]
    return [*slow_segments(scores[:a]), (a, b, best[0]),
            *((x + b, y + b, s) for x, y, s in slow_segments(scores[b:]))]


@pytest.mark.parametrize("seed", range(12))
def test_segments(seed):
    import random

    dice = random.Random(seed)
    hits = {i: dice.choice([0.6, 1.1, 2.3]) for i in range(60) if dice.random() < 0.2}
    scores = [hits.get(i, toxicity.OTHER) for i in range(60)]
    got = toxicity.segments(sorted(hits.items()))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in slow_segments(scores)]


def test_toxicity_edges(docs, no_docs, labels):
    model = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    empty = toxicity.learn(no_docs, labels.where("false"))
    assert empty["weights"] == {} and {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}


def test_toxicity_held_out(spark):
    dice = [(i * 2654435761) % 997 for i in range(600)]
    rows = [(i, " ".join(f"w{(d * k) % 89}" for k in range(40)) + (" vile lout" if d % 3 == 0 else "") + " end",
             int(d % 3 == 0)) for i, d in enumerate(dice)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), df.where("doc_id < 400").select("doc_id", "toxic"))
    got = {r.doc_id: r.score >= toxicity.TOXIC_FROM for r in toxicity.score(df.where("doc_id >= 400"), model).collect()}
    assert got == {i: bool(t) for i, _, t in rows if i >= 400}


def test_leaks_against_all_windows(spark, docs, no_docs):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "two words"), (3, None), (4, "")], "item_id long, text string")
    texts = [f"a b {item.upper()}, c", item.replace("q19", "zz"), item.replace("q9", "zz"), "say Two. Words here", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontamination.find_leaks(df, bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        w = decontamination.WORD.findall((t or "").lower())
        for k, other in ((1, item), (2, "two words")):
            o = decontamination.WORD.findall(other)
            c = Counter(decontamination.shingles(o, 5))
            best = max((decontamination.weighted_similarity(Counter(decontamination.shingles(w[s:s + len(o)], 5)), c)
                        for s in range(max(1, len(w) - len(o) + 1))), default=0)
            if best >= 0.8:
                want[i, k] = round(best, 6)
    assert got == want and (1, 1) in want and (2, 1) not in want
    assert sorted(r.doc_id for r in decontamination.without_leaks(df, bench).collect()) == [2, 4]
    assert decontamination.without_leaks(docs, bench).columns == docs.columns
    assert decontamination.find_leaks(no_docs, bench).count() == 0
    assert decontamination.find_leaks(docs, bench.where("false")).count() == 0


def test_multi_index_guarantee():
    prints = [(17 * k + 5) ** 11 % (1 << 64) for k in range(200)]
    index = decontamination.Fingerprints(prints, 20)
    for p in prints[:20]:
        wanted = p ^ 0x8421_0842_1084_2108
        assert index.near(wanted) == {i for i, q in enumerate(prints) if (q ^ wanted).bit_count() <= 20}


def test_line_repeats(spark, docs, no_docs):
    passage = "one two three four five six. Seven eight nine ten eleven twelve."
    texts = [f"Start a. {passage} End b.", f"Other c\n{passage.upper()}\nlast d", "short. Short.", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = line_dedup.repeats(line_dedup.units(df)).collect()
    assert [(r.doc_id, r.first_doc_id, r.n_words) for r in rows] == [(1, 0, 12)]
    assert texts[1][rows[0].start:rows[0].stop] == passage.upper()
    out = {r.doc_id: r.text for r in line_dedup.without_repeats(df).collect()}
    assert out == {**dict(enumerate(texts)), 1: "Other c\n\nlast d"}
    assert line_dedup.repeats(line_dedup.units(docs)).where("doc_id = 1 AND start = 0").count() == 0
    assert line_dedup.repeats(line_dedup.units(no_docs)).count() == 0


def test_rules_and_reputation(spark):
    urls = ["http://A.example.NET/en/5?q", "https://x.net", "ftp://example.com/de/1#h", None, "no host", "http://m.org/fr/7",
            *(f"http://bad.example.info/{k}" for k in range(40)), *(f"http://ok{k}.example.biz/{k % 40 + 50}" for k in range(400))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k >= 50), 0) for k in range(90)], "doc_id long, quality int, toxic int")
    rows = {r.page_id: r for r in url_reputation.judge(url_reputation.page_outcomes(pages, labels)).collect()}
    assert [(rows[k].host, rows[k].path, rows[k].rule, rows[k].verdict) for k in range(6)] == [
        ("a.example.net", "/en/5", "example.net/en/", "allow"), ("x.net", "", None, "allow"),
        ("example.com", "/de/1", "example.com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("m.org", "/fr/7", "org/fr/", "allow")]
    assert {rows[k].verdict for k in range(6, 46)} == {"block"}
    assert {rows[k].verdict for k in range(46, 446)} == {"allow"}
    assert url_reputation.judge(url_reputation.page_outcomes(pages.where("false"), labels)).count() == 0


def test_chat_layouts(spark):
    turns = [{"role": "user", "content": "a<b>\\l"}, {"role": "assistant", "content": "</turn>\n\\"}]
    records = [json.dumps(r) for r in (
        {"messages": turns, "extra": 1}, {"conversations": [{"from": "human", "value": "a<b>\\l"},
                                                            {"from": "gpt", "value": "</turn>\n\\"}]},
        {"prompt": "a<b>\\l", "completion": "</turn>\n\\"}, {"instruction": "a<b>\\l", "input": "", "output": "</turn>\n\\"},
        {"other": 1})] + ["broken", None]
    df = spark.createDataFrame([(r,) for r in records], "j string").select(chat.turns_of_json(
        chat.F.col("j")).alias("t"))
    got = [r.t and [(t.role, t.text) for t in r.t] for r in df.collect()]
    assert got == [[("user", "a<b>\\l"), ("assistant", "</turn>\n\\")]] * 4 + [None] * 3
    table = spark.createDataFrame([(1, turns, "x")], "id long, messages array<struct<role:string,content:string>>, role string")
    back = chat.read_back(chat.formatted(chat.turn_rows(table))).first()
    assert [(t.role, t.text) for t in back.turns] == got[0] and back.learned == "</turn>\n\\"


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (1, 0, None, "hi"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.read_back(chat.formatted(chat.turn_rows(df)))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 0 and got[None].n_turns == 1
    assert got[1].turns_sha256 == hashlib.sha256(b"\nhi\n\nhi\nassistant\n\n").hexdigest()
    assert chat.formatted(chat.turn_rows(df.where("false"))).count() == 0


def test_toxicity_of_many_weak_segments():
    """A long text with scattered toxic words, more of them than chance makes, however weak each is."""
    def text(rate, tokens, segments, strength):
        expected = rate * -toxicity.OTHER * tokens * math.exp(-rate * strength)
        return toxicity.toxicity([(k, k + 1, strength, expected) for k in range(segments)])

    assert text(1.6, 200_000, 60, 5.0) > 0.999999 and text(1.8, 200_000, 80, 4.0) > 0.9
    assert text(1.6, 200_000, 20, 5.0) < 0.1 and text(1.6, 4_000_000, 600, 5.0) > 0.99
    assert toxicity.below(3, 0.0) == 1.0 and toxicity.below(5_000, 10.0) == 1.0 and toxicity.below(1, 1e6) == 0.0
    for r, expected in ((1, 0.3), (4, 4.0), (30, 26.8), (20, 26.8)):
        slow = sum(math.exp(-expected) * expected ** i / math.factorial(i) for i in range(r))
        assert abs(toxicity.below(r, expected) - slow) < 1e-12


def test_reordered_leaks_against_all_windows():
    """Items with their parts swapped, repeated words and edits, in texts longer and shorter than the item."""
    import random

    dice = random.Random(5)
    items = [[f"i{k}w{i}" for i in range(100)] for k in range(2)] + [[dice.choice("abcd") for _ in range(40)]]
    bench = decontamination.Benchmark([(k, " ".join(w)) for k, w in enumerate(items)], 5, 20, 0.8)
    pad, texts = [f"p{i}" for i in range(60)], []
    for w in items:
        half = len(w) // 2
        texts += [pad + w[half:] + w[:half] + pad, pad + w[half:] + ["gap"] + w[:half] + pad, w[half + 4:] + w[:half + 4],
                  pad + w[:-3], w[1:-1], w * 3, pad + w[10:20] + w[:10] + w[20:] + pad + w]
    swapped = 0
    for text in texts:
        want = {}
        for k, w in enumerate(items):
            c = Counter(decontamination.shingles(w, 5))
            found = [(decontamination.weighted_similarity(Counter(decontamination.shingles(text[s:s + len(w)], 5)), c), -s)
                     for s in range(max(1, len(text) - len(w) + 1))]
            if max(found)[0] >= 0.8:
                want[k] = (-max(found)[1], max(found)[0])
        got = {i: (start, similarity) for i, start, _, _, similarity in bench.leaks(" ".join(text))}
        assert got == want
        swapped += text is texts[0] and 0 in want
        windows = bench.windows(text)
        assert list(bench.prints_of(text, windows)) == [bench.print_of(text[s:s + n]) for s, n in windows]
    assert swapped
