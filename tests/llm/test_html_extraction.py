"""Page extraction: blocks, the random field against enumeration, labelled pages, and layouts the model has not seen."""

import itertools
import math
import re
import time

import numpy as np
import pytest

from pagewright.llm import crf
from pagewright.llm import html_extraction as hx
from pagewright.llm.dom_blocks import chain, leaf_blocks


@pytest.fixture(scope="module")
def model():
    chains, labels = hx.composed_chains()
    return crf.fit(chains, labels)


def texts(html):
    return [block.text for block in leaf_blocks(html)]


def test_blocks():
    assert texts("<p>a <b>b</b>c\n d&amp;e<p>f<br>g</p>h") == ["a bc d&e", "f g", "h"]
    assert texts("<title>t</title><style>p{}</style><script>x='</p><p>'</SCRIPT ><p>a<!-- <p>b --></p>") == ["a"]
    assert texts('<a title="x > y" class=\'>\'>k</a> <ul><li>1<li>2<ul><li>3</ul><li>4</ul>') == ["k", "1", "2", "3", "4"]
    assert texts("1 < 2 &lt;p&gt; &quo &#233;&nbsp;x <3 <?php a ?><!doctype x>z") == ["1 < 2 <p> &quo é x <3 z"]
    assert texts(None) == texts("") == texts(" \n ") == texts("<p></p>") == []
    assert texts("a<") == ["a<"] and texts("a<p") == ["a"] and texts("a<!-- b") == ["a"] and texts('a<p x="> b') == ["a"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table></div></p>d") == ["a", "b", "c", "d"]


@pytest.mark.parametrize("html", [
    "<" * 300_000, "<p " * 100_000, '<a href="' * 100_000, "<!--" * 100_000, "<div class='x y'>" * 50_000 + "<p>t",
    "<script>" * 100_000, "&" * 300_000, "<ul><li>" * 30_000 + "x", "<p>w " * 60_000, "</div>" * 100_000])
def test_odd_pages_take_linear_time(model, html):
    start = time.time()
    hx.main_text(html, model, frozenset(model.weights))
    assert time.time() - start < 10


def test_field_equals_enumeration():
    rng = np.random.default_rng(1)
    for size in (1, 2, 5):
        features = [[f"f{rng.integers(4)}", "any"] for _ in range(size)]
        same = [False, *map(bool, rng.integers(0, 2, size - 1))]
        field = crf.Model({f"f{i}": float(rng.normal()) for i in range(4)} | {"any": .3}, rng.normal(0, 1, (2, 2, 2)).tolist())

        def score(labels):
            return (sum(field.weights[name] for block, y in zip(features, labels, strict=True) if y for name in block)
                    + sum(field.steps[same[no]][labels[no - 1]][labels[no]] for no in range(1, size)))

        ways = list(itertools.product((0, 1), repeat=size))
        assert tuple(crf.decode((features, same), field)) == max(ways, key=score)
        total = sum(math.exp(score(w)) for w in ways)
        scores = np.array([[sum(field.weights[name] for name in block) for block in features]])
        one, moves = crf.expected(scores, np.array([same]).astype(int), np.array([size - 1]), [1] * size, np.array(field.steps))
        assert np.allclose(one[0], [sum(math.exp(score(w)) for w in ways if w[no]) / total for no in range(size)])
        assert np.isclose(moves.sum(), size - 1)


def test_learning_finds_the_labels():
    chains = [([["a"], ["b"], ["b"], ["a"]], [False, True, False, True])] * 5
    field = crf.fit(chains, [[1, 0, 1, 0]] * 5)
    assert crf.decode(chains[0], field) == [1, 0, 1, 0]
    assert crf.decode(([], []), field) == [] and crf.fit([], []).weights == {}


def test_unseen_composed_pages(model):
    """Held-out pages of another seed: at least 99% of the blocks right."""
    right = total = 0
    for page in hx.composed_pages(150, seed=77):
        blocks = leaf_blocks(page)
        wanted = [hx.MAIN in block.text for block in blocks]
        for block in blocks:
            block.text = block.text.replace(hx.MAIN, "").strip() or "x"
        right += sum(a == b for a, b in zip(crf.decode(chain(blocks), model), wanted, strict=True))
        total += len(wanted)
    assert right / total > .99


PAGE = """<!DOCTYPE html><html><head><title>News</title></head><body><header class="site-header"><a href="/">Daily News</a>
<p>All the news that fits</p></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li></ul></nav>
<div id="cookieBanner" class="cookie-consent"><p>We use cookies to improve this site.</p><button>Accept</button></div>
<main><article><h1>Rivers &amp; lakes</h1><p>The first paragraph&nbsp;tells <a href="x">what</a>
 happened, at some length, and ends here.</p><div class="advertisement">Buy two, get one.</div><h2>Later</h2>
<ul><li>One point of the list.</li><li>Another point.</li></ul><p>Short.</p><form action="/n"><p>Sign up for our letter</p>
<button>Go</button></form><p>The last paragraph of this article is a little longer than the one before it.</p></article></main>
<section id="comments" class="reader-comments"><h3>2 comments</h3><div class="comment"><p>I liked this article a lot, thanks.</p></div>
<div class="comment"><p>So did I. It was a good read from start to end.</p></div></section>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">A story</a></li></ul><p>A text beside the article.</p></aside>
<footer><p>&copy; 2024 Daily News. All rights reserved.</p></footer></body></html>"""
MAIN_TEXT = """Rivers & lakes
The first paragraph tells what happened, at some length, and ends here.
Later
One point of the list.
Another point.
Short.
The last paragraph of this article is a little longer than the one before it."""


def test_page_with_everything_around(spark, model):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"),
                                   (3, "w", "<p>", "x"), (4, "w", "<article><p>" + "word " * 200_000, "x")],
                                  "page_id long, url string, html string, text string")
    out = sorted(map(tuple, hx.extracted(pages, model).collect()), key=str)
    assert [row[:3] for row in out if row[0] == 1] == [(1, "u", MAIN_TEXT)] * 2
    assert (2, None, "", 0) in out and (None, "v", "", 0) in out and (3, "w", "", 0) in out
    assert next(row for row in out if row[0] == 4)[3] == 200_000 * 5 - 1
    assert all(row[3] == len(row[2]) for row in out)
    assert hx.extracted(pages.where("false"), model).count() == 0


def test_labels_from_documents():
    assert hx.labels_from(["nav", "Tit", "Title one", "two", "foot"], "Title one\n\n two \n") == [0, 1, 1, 1, 0]
    assert hx.labels_from(["One.", "One."], "One.") == [1, 1]
    assert hx.labels_from(["a", "b"], "b\na") is None and hx.labels_from(["a"], "") is None and hx.labels_from([], "a") is None


def test_all_pages_against_their_documents(spark, sf_dir):
    """The text of every page that a document labels is that document, with the heading; so of pages not learned from."""
    pages, docs = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("pages", "documents"))
    field = hx.learned(pages.limit(20), docs)
    text = {row.doc_id: row.text for row in docs.collect()}
    checked = 0
    for row in hx.extracted(pages, field).join(pages.select("page_id", "html"), "page_id").collect():
        number = int(re.search(r"://[^/]*/.*?(\d+)", row.url)[1])
        blocks = [block.text for block in leaf_blocks(row.html)]
        labels = hx.labels_from(blocks, text.get(number, ""))
        if labels:
            checked += 1
            assert row.text == "\n".join(block for block, y in zip(blocks, labels, strict=True) if y)
    assert checked > 40


def test_no_documents(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    assert hx.labelled_chains(pages, docs) == ([], []) and hx.labelled_chains(pages.where("false"), docs) == ([], [])
