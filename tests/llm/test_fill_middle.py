"""Fill-in-the-middle against plain string work."""

import hashlib
import re

from pagewright.llm import fill_middle as fim


def plainly(doc_id, text):
    """The form and the output by slicing strings."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def as_row(r):
    return r.n, r.form, r.prefix_chars, r.middle_chars, r.output


def test_equals_string_work(spark, docs):
    texts = [f"ab{'é' * (i % 5)} c1{i}\n<X> \U0001f600z" * (i % 4) for i in range(300)] + ["a <P> b", "<S>", "x<M>", "<", "<P", ">"]
    more = spark.createDataFrame([(100 + i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, form string")
    df = docs.select("doc_id", "text", "source").withColumnRenamed("source", "form").unionByName(more)
    want = sorted(map(str, ((r.doc_id, *plainly(r.doc_id, r.text)) for r in df.collect())))
    made = fim.fill_in_middle(df)
    got = made.collect()
    assert sorted(str((r.doc_id, *as_row(r))) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sum(r.doc_id == 2 for r in got) == 2, "repeated rows stay"
    shas = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.digests(made).collect()}
    assert shas == {(r.doc_id, hashlib.sha256(as_row_text[-1].encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
                    for r in df.collect() for as_row_text in [plainly(r.doc_id, r.text)]}


def test_empty_table(no_docs):
    out = fim.digests(fim.fill_in_middle(no_docs))
    assert out.count() == 0 and out.columns[0] == "doc_id"


def test_table_restores():
    text = "one two\nthree é " * 9
    for form in ("psm", "spm"):
        for a in range(0, len(text) + 1, 7):
            for b in range(a, len(text) + 1, 11):
                made = fim.PieceTable(text).cut(a, b).arrange(form)
                again = fim.PieceTable.of_output(made.text(), form)
                assert again.sha256() == made.sha256() and again.restore(form).text() == text
                assert made.restore(form).text() == text and len(made.pieces) == 3


def test_longest_text_is_cut_whole():
    text = "word, " * 400_000
    made, form, n, _ = fim.arranged(text, 4, fim.SEED)
    assert n == 3 * 400_000 and (form == "plain" or made.restore(form).text() == text)
