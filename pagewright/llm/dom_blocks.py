"""Web pages as leaf blocks: runs of text between block-level tags, with what their ancestors and their text say.

One pass over the page, linear in its length also where tags, quotes or comments never end; what an unfinished tag
holds is dropped, as browsers do. Scripts, styles, titles and comments give no blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

#: The block-level and raw-text element names of HTML.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav noscript
ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul""".split())
RAW = frozenset("script style title xmp noembed noframes template svg".split())
VOID = frozenset(["hr"])
#: Elements that an opening tag ends, and those that such a search does not leave.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
        "option": ({"option"}, {"select"})}
#: Elements that only shape text: blocks in the same other element belong together.
SHAPES = frozenset("p li h1 h2 h3 h4 h5 h6 ul ol dl dt dd tr td th tbody thead pre blockquote figcaption figure".split())
#: Parts of class names and ids, and of texts, that tell what a block is for.
CUES = """comment sidebar footer header menu navi cookie consent newsletter subscri breadcrumb advert sponsor promo banner
share social related recommend popup modal widget login signup search content article post entry story body text main
notice alert disclaimer legal toolbar pager pagination meta author byline reply respond discuss feedback hidden""".split()
WORDS = """© cookie copyright subscribe newsletter advertisement sponsored privacy reply comment login share
rights""".split()

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
TOKEN = re.compile("[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    #: Number of the element that holds the block, shapes left aside.
    owner: int
    #: Characters inside links.
    linked: int
    ancestors: list[str] = field(default_factory=list)


def attribute_features(attributes: str) -> list[str]:
    out = []
    for name, *values in ATTRIBUTE.findall(attributes):
        for token in TOKEN.findall("".join(values) or name):
            token = token.lower()
            out.append(f"is:{token}")
            out += [f"cue:{cue}" for cue in CUES if cue in token]
    return out


class _Reader:
    def __init__(self, known: frozenset[str] | None) -> None:
        self.known, self.blocks = known, []
        self.stack: list[tuple[str, list[str], int]] = []
        self.open, self.active = Counter(), Counter()
        self.parts: list[str] = []
        self.link, self.linked, self.owners = False, 0, 0

    def add(self, run: str) -> None:
        if run:
            run = unescape(run)
            self.parts.append(run)
            if self.link:
                self.linked += len(run.strip())

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            tag, _, owner = self.stack[-1] if self.stack else ("body", [], 0)
            self.blocks.append(Block(text, owner, self.linked, [*self.active, f"tag:{tag}"]))
        self.parts, self.linked = [], 0

    def pop(self) -> str:
        tag, features, _ = self.stack.pop()
        self.open[tag] -= 1
        for name in features:
            self.active[name] -= 1
            if not self.active[name]:
                del self.active[name]
        return tag

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link = True
        if tag == "br":
            self.parts.append(" ")
        if tag not in BLOCKS:
            return
        self.flush()
        self.link = False
        while self.stack and self.stack[-1][0] == "p":
            self.pop()
        ended, inside = ENDS.get(tag, ((), ()))
        if any(self.open[name] for name in ended):
            at = len(self.stack) - 1
            while at >= 0 and self.stack[at][0] not in ended and self.stack[at][0] not in inside:
                at -= 1
            if at >= 0 and self.stack[at][0] in ended:
                while len(self.stack) > at:
                    self.pop()
        if tag in VOID:
            return
        features = [f"in:{tag}", *attribute_features(attributes)]
        if self.known is not None:
            features = [name for name in features if name in self.known]
        owner = self.stack[-1][2] if self.stack else 0
        if tag not in SHAPES:
            self.owners += 1
            owner = self.owners
        self.stack.append((tag, features, owner))
        self.open[tag] += 1
        self.active.update(features)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag not in BLOCKS:
            return
        self.flush()
        self.link = False
        if self.open[tag]:
            while self.pop() != tag:
                pass


def leaf_blocks(html: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """The blocks of a page in their order. With `known`, only these ancestor features are kept, so that depth costs nothing."""
    html, reader, at = html or "", _Reader(known), 0
    while True:
        mark = html.find("<", at)
        if mark < 0 or mark + 1 >= len(html):
            reader.add(html[at:])
            break
        ahead = html[mark + 1]
        closing = ahead == "/"
        name = NAME.match(html, mark + 1 + closing)
        if name is None:
            if html.startswith("!--", mark + 1):
                reader.add(html[at:mark])
                end = html.find("-->", mark + 2)
                at = len(html) if end < 0 else end + 3
            elif ahead in "!?/":
                reader.add(html[at:mark])
                end = html.find(">", mark)
                at = len(html) if end < 0 else end + 1
            else:
                reader.add(html[at:mark + 1])
                at = mark + 1
            continue
        reader.add(html[at:mark])
        end = name.end()
        while True:
            stop = STOP.search(html, end)
            if stop is None or stop[0] == ">":
                break
            end = html.find(stop[0], stop.end()) + 1
            if not end:
                stop = None
                break
        if stop is None:
            break
        tag, at = name[0].lower(), stop.end()
        if closing:
            reader.end(tag)
            continue
        reader.start(tag, html[name.end():stop.start()])
        if tag in RAW and html[stop.start() - 1] != "/":
            close = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            at = close.start() if close else len(html)
    reader.flush()
    return reader.blocks


# ------------------------------------------------------------------ features
def size_of(text: str) -> str:
    words = text.count(" ") + 1
    return next((name for name, most in (("1", 1), ("3", 3), ("8", 8), ("20", 20), ("60", 60)) if words <= most), "more")


def text_features(block: Block) -> list[str]:
    text = block.text
    linked = block.linked / len(text)
    out = [f"words:{size_of(text)}", "links:none" if not linked else "links:some" if linked < .6 else "links:most"]
    if text[-1] in ".!?…:;\"'”»)":
        out.append("stops")
    if text[0].isupper():
        out.append("capital")
    low = text[:400].lower()
    out += [f"says:{word}" for word in WORDS if word in low]
    return out


def chain(blocks: list[Block]) -> tuple[list[list[str]], list[bool]]:
    """Features of every block, those of its neighbours' size included, and whether its element is the one before."""
    own = [text_features(block) for block in blocks]
    features = []
    for no, block in enumerate(blocks):
        before = own[no - 1][0] if no else "start"
        behind = own[no + 1][0] if no + 1 < len(blocks) else "end"
        features.append(["any", *block.ancestors, *own[no], f"before:{before}", f"behind:{behind}"])
    same = [no > 0 and blocks[no - 1].owner == block.owner for no, block in enumerate(blocks)]
    return features, same
