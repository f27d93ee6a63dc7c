"""Main text of web pages: a conditional random field over leaf blocks, decoded by Viterbi.

Labelled pages come from two sides. Pages whose url numbers a document are labelled by it: the blocks that are its lines,
in order, and the heading before them that its first line starts with, are main text. That needs no knowledge of the
markup, but shows only the layouts of these pages; so pages composed from labelled parts add the layouts that pages have
elsewhere (sidebars, notices, forms, reader comments, articles without semantic elements).
"""

from __future__ import annotations

import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .dom_blocks import chain, leaf_blocks
from .shared import by_slice, table

#: Pages labelled through documents that the model learns from (on average, chosen by hash), the most blocks of such a
#: page, and composed pages.
SAMPLE, MOST_BLOCKS, COMPOSED = 300, 150, 500
SEED = 11

# ------------------------------------------------------------------ composed pages
#: Marks main text in composed pages; taken out before features are made.
MAIN = "\ue000"
#: Parts by place. T a few words, S a sentence, P a paragraph, L a list of links; upper case main text, lower case not.
OUTER = {"article": "<article>{}</article>", "main": "<main>{}</main>", "both": "<main><article>{}</article></main>",
         "content": '<div id="content">{}</div>', "post": '<div class="post-body">{}</div>',
         "entry": '<div class="entry-content">{}</div>', "role": '<div role="main">{}</div>',
         "story": '<section class="story">{}</section>', "div": "<div>{}</div>",
         "cell": "<table><tr><td>l</td><td>{}</td></tr></table>", "bare": "{}"}
HEADS = ["<h1>T</h1>", "<header><h1>T</h1></header>", "<h1>T</h1><h2>S</h2>", "", "<h2>T</h2>"]
BODY = 8 * ["<p>P</p>"] + 4 * ["<p>S</p>"] + [
    "<p>T</p>", "<p>T", "<h2>T</h2><p>P</p>", "<h3>T</h3><p>S</p>", "<ul><li>S</li><li>T</li><li>S</li></ul>",
    "<ol><li>P</li><li>S</li></ol>", "<blockquote><p>P</p></blockquote>", "<blockquote>S</blockquote>", "<pre>S</pre>",
    "<table><tr><th>T</th><th>T</th></tr><tr><td>T</td><td>S</td></tr></table>", "<div>P</div>", "<p><a>S</a> S</p>",
    "<figure><img src=x><figcaption>S</figcaption></figure>", "<p><b>S<br><p>P</p>", "<dl><dt>T</dt><dd>S</dd></dl>",
    "<section><h3>T</h3><p>P</p><p>P</p></section>", "<p><a>T</a></p>", "<ul><li><a>S</a></li><li>P</li></ul>", "<p>T</p><p>T</p>"]
BETWEEN = [
    '<div class="ad">s</div>', '<div class="advert"><p>s</p></div>', '<div class="ads"><a>s</a></div>',
    "<aside><p>s</p></aside>", "<aside><h3>t</h3><p>p</p></aside>", '<div class="share">l</div>',
    '<div class="sponsored"><p>p</p></div>', "<form><p>s</p><label>t</label><button>t</button></form>",
    '<div class="newsletter"><h3>t</h3><p>s</p><form><label>t</label><button>t</button></form></div>',
    '<div class="notice"><p>s</p></div>', '<nav class="toc"><ul><li><a>t</a></li><li><a>t</a></li></ul></nav>',
    '<div class="related"><h3>t</h3><ul><li><a>s</a></li><li><a>s</a></li></ul></div>', '<div class="promo"><p>s</p></div>',
    '<footer><p>s</p></footer>', "<script>var s = '<p>x</p>';</script>", "<!-- p -->", "<noscript>s</noscript>",
    '<div class="sidebar"><p>p</p></div>', '<section class="comments"><h2>t</h2><p>p</p></section>']
BEFORE = [
    '<header><div class="logo">t</div><p>s</p></header>', '<div id="header"><h1>t</h1><p>s</p></div>', "<header><p>p</p></header>",
    "<nav><ul>l</ul></nav>", '<div class="menu">l</div>', '<div class="cookie-notice"><p>s</p><button>t</button></div>',
    '<div class="breadcrumbs"><a>t</a> &gt; <a>t</a></div>', '<form class="search"><label>t</label><button>t</button></form>',
    '<div class="ad">s</div>', '<div class="banner"><p>p</p></div>', '<div role="banner">t</div>', "<div><ul>l</ul></div>",
    '<div class="alert notice"><p>p</p></div>', '<div id="cookie-consent">s</div>', '<form><p>p</p><label>t</label><select><option>t</select></form>',
    '<ul id="nav">l</ul>', '<aside class="left"><p>p</p><p>s</p></aside>', '<div role="navigation">l</div>', "<p>l</p>"]
AFTER = [
    "<footer>s</footer>", "<footer><p>p</p><ul>l</ul></footer>", '<div id="footer"><p>© t</p></div>', "<p>© t rights</p>",
    '<aside class="sidebar"><h3>t</h3><ul>l</ul><p>p</p></aside>', "<aside><h2>t</h2><p>p</p><p>s</p></aside>",
    '<div id="sidebar"><h3>t</h3><p>p</p><ul>l</ul></div>', '<div class="related"><h3>t</h3><ul>l</ul></div>',
    '<section class="comments"><h2>t</h2><article class="comment"><p class="author">t</p><p>p</p></article>'
    "<article class=\"comment\"><p>s</p><p>p</p></article></section>",
    '<div id="comments"><h3>t</h3><ol class="commentlist"><li><div class="comment-body"><p>p</p><p>s</p></div></li>'
    "<li><p>p</p></li></ol><form><p><label>t</label><textarea>s</textarea></p><button>t</button></form></div>",
    '<div class="reader-comments"><div><b>t</b><p>p</p></div><div><p>s</p></div></div>',
    '<section id="respond"><h3>t</h3><form><p>s</p><button>t</button></form></section>', '<div class="share">l</div>',
    '<div class="subscribe"><p>s</p><form><button>t</button></form></div>', '<div class="advertisement"><p>p</p></div>',
    '<div class="disclaimer"><p>p</p></div>', '<div class="widget"><h3>t</h3><p>s</p></div>', '<nav>l</nav>']
SYLLABLES = "ba ti ren so lun mar el vi cho da est or in fa que".split()


def _fill(part: str, rng: random.Random) -> str:
    def few() -> str:
        return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 5))).capitalize()

    def sentence() -> str:
        return " ".join(few().lower() for _ in range(rng.randint(2, 6))).capitalize() + rng.choice([".", ".", ".", "", "!", "&amp;"])

    def text(match: re.Match) -> str:
        kind = match[0].lower()
        made = {"t": few, "s": sentence, "p": lambda: " ".join(sentence() for _ in range(rng.randint(2, 9))),
                "l": lambda: "".join(f"<li><a href=x>{few()}</a></li>" for _ in range(rng.randint(2, 7)))}[kind]()
        return MAIN + made if match[0].isupper() else made

    return re.sub(r"(?<![\w<\"'-])[TSPLtspl](?![\w=\"'-])(?![^<]*>)", text, part)


def composed_pages(count: int = COMPOSED, seed: int = SEED) -> list[str]:
    """Pages put together from the parts; the same ones for the same seed."""
    rng, pages = random.Random(seed), []
    for no in range(count):
        body = [rng.choice(HEADS)]
        for _ in range(rng.randint(1, 12)):
            body.append(rng.choice(BODY))
            if rng.random() < .12:
                body.append(rng.choice(BETWEEN))
        around = ["".join(rng.choices(parts, k=rng.randint(0, 4))) for parts in (BEFORE, AFTER)]
        outer = list(OUTER.values())[no % len(OUTER)]
        wrap = rng.choice(["{}", "{}", '<div class="container">{}</div>', '<div id="wrapper"><div>{}</div></div>'])
        inside = outer.replace("<td>l</td>", "<td><ul>l</ul></td>").format("".join(body))
        pages.append("<html><head><title>t</title></head><body>" + _fill(wrap.format(around[0] + inside + around[1]), rng))
    return pages


def composed_chains(count: int = COMPOSED) -> tuple[list[crf.Chain], list[list[int]]]:
    chains, labels = [], []
    for page in composed_pages(count):
        blocks = leaf_blocks(page)
        labels.append([int(MAIN in block.text) for block in blocks])
        for block in blocks:
            block.text = block.text.replace(MAIN, "").strip() or "x"
        chains.append(chain(blocks))
    return chains, labels


# ------------------------------------------------------------------ pages labelled by documents
def labels_from(texts: list[str], document: str) -> list[int] | None:
    """1 for the blocks that are the lines of a document, and for its heading; None if they are not found in order."""
    lines = [line for line in (" ".join(line.split()) for line in document.split("\n")) if line]
    for at in range(len(texts) - len(lines), -1, -1) if lines else ():  # from the end: a heading may equal a line
        if texts[at:at + len(lines)] == lines:
            heading = at > 0 and lines[0].startswith(re.sub(r"\s*&\w*$", "", texts[at - 1])) and len(texts[at - 1]) > 2
            return [int(at - heading <= no < at + len(lines)) for no in range(len(texts))]
    return None


def labelled_chains(pages: DataFrame, documents: DataFrame, sample: int = SAMPLE) -> tuple[list[crf.Chain], list[list[int]]]:
    """Features and labels of a sample of the pages whose url numbers a document (the first number of its path).

    Bounded: about `sample` pages, chosen by a hash of (page_id, url), and their documents; of repeated ids the least text.
    Only features and labels reach the driver.
    """
    count = pages.count()
    number = F.regexp_extract("url", r"://[^/?#]*[^?#]*?/([0-9]{1,18})(?![0-9A-Za-z])", 1).try_cast("long")
    chosen = F.xxhash64("page_id", "url") / 2.0 ** 64 + .5 < F.lit(min(1.0, sample / max(count, 1)))
    picked = (pages.where(F.col("html").isNotNull() & chosen).groupBy("page_id", "url").agg(F.min("html").alias("html"))
              .select(number.alias("doc_id"), "html").where("doc_id IS NOT NULL"))
    ids = [row.doc_id for row in picked.select("doc_id").distinct().collect()]
    found = (documents.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("text").alias("text")))

    def work(batch: pa.RecordBatch) -> dict:
        out = {"features": [], "same": [], "labels": []}
        for html, text in zip(batch["html"].to_pylist(), batch["text"].to_pylist(), strict=True):
            blocks = leaf_blocks(html)
            labels = labels_from([block.text for block in blocks], text) if len(blocks) <= MOST_BLOCKS else None
            if labels:
                features, same = chain(blocks)
                out["features"].append("\n".join("\t".join(names) for names in features))
                out["same"].append("".join("01"[x] for x in same))
                out["labels"].append("".join(map(str, labels)))
        return out

    rows = by_slice(picked.join(found, "doc_id").select("html", "text"), work,
                    "features string, same string, labels string").collect()
    rows.sort()
    chains = [([line.split("\t") for line in row.features.split("\n")], [x == "1" for x in row.same]) for row in rows]
    return chains, [list(map(int, row.labels)) for row in rows]


def learned(pages: DataFrame, documents: DataFrame) -> crf.Model:
    """The model from both kinds of labelled pages; without pages from the composed ones."""
    chains, labels = composed_chains()
    more, further = labelled_chains(pages, documents)
    return crf.fit(chains + more, labels + further)


# ------------------------------------------------------------------ extraction
def main_text(html: str | None, model: crf.Model, known: frozenset[str]) -> str:
    blocks = leaf_blocks(html, known)
    return "\n".join(block.text for block, label in zip(blocks, crf.decode(chain(blocks), model), strict=True) if label)


def extracted(pages: DataFrame, model: crf.Model) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, from its whole page.

    Blocks keep their order and come one a line, with character references decoded and white space as single spaces.
    NULL and empty pages, and those without main text, give an empty text. Rows are independent: repeated ids and repeated
    rows each give a row, an empty table none, further columns do not matter.
    """
    known = frozenset(model.weights)

    def work(batch: pa.RecordBatch) -> dict:
        texts = [main_text(html, model, known) for html in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": list(map(len, texts))}

    return by_slice(pages.select(F.col("page_id").cast("long"), "url", "html"), work,
                    "page_id long, url string, text string, n_chars long")


def op11_dom_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, learned(pages, table(spark, sf_dir, "documents")))
