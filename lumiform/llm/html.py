"""HTML extraction: flat text blocks, described by the word counts and link densities of themselves and their
neighbours, classified by a decision tree that is trained here on a small labelled table.

Parsing settles only what elements mean by themselves: scripts, styles and forms are no text, and what stands in a menu, a
sidebar, a header or footer of the page or a dialog is never the article. All else is the tree's decision, inside article
elements too: related links, link lists, notices, adverts and reader comments go by their counts, their links and those of
what is around them. A class or id drops nothing by itself. It marks a box, and the tree sees how many words the box has, how
many of them are links, and what share of the page it is.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiform.llm.common import chunks, table

# Names of HTML elements by what they mean for blocks.
RAW = frozenset("script style textarea title template noembed noframes iframe".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside body button datalist details dialog div dl fieldset figure footer form head header html main menu nav noscript ol p search section select table ul h1 h2 h3 h4 h5 h6 li blockquote span".split())
BARRED = frozenset("aside button datalist dialog fieldset footer form head menu nav noscript search select".split())
ARTICLE = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words in class and id that mark boxes: of reader comments and adverts, and of other things beside an article.
FOREIGN_WORDS = frozenset("comment comments commentlist disqus replies respond ad ads advert adverts advertisement sponsored".split())
BESIDE_WORDS = frozenset("promo related newsletter share social cookie cookies consent notice banner subscribe".split())
#: Words that notices of sites are full of.
NOTICE_WORDS = frozenset("cookie cookies consent gdpr privacy policy accept reject agree subscribe subscription newsletter sign login log register advertisement sponsored site website experience uses browser javascript settings".split())

NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile("[>\"']")
LINK = {"</a": re.compile(r"</a[\s>]", re.I), "<a": re.compile(r"<a[\s>]", re.I)}
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true", re.I)


class Block(NamedTuple):
    text: str
    words: int
    linked: int  # words inside links
    tags: int  # tags inside
    barred: int  # containers that can't hold the article
    article: int  # 1 inside an article or main element
    heading: int
    foreign: int  # 1 inside a box named as comments or advert
    box: int  # number of the outermost box named as beside the article, or -1
    notice: int  # words of NOTICE_WORDS


FOREIGN, BESIDE = 1, 2


def kind_of(tag: str, attributes: str, inside: int) -> tuple[int, int]:
    """1 for a container that can't hold the article, -1 for an article or main element, 2 for a hidden one, else 0; and the box that its names mark."""
    names: set[str] = set()
    if attributes:
        if HIDDEN.search(attributes):
            return 2, 0
        for m in NAMED.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            names |= {f"role:{value}"} if m[1].lower() == "role" else set(re.split(r"[\s_-]+", value))
    if tag in BARRED or (tag == "header" and not inside):
        return 1, 0
    box = 0
    if tag not in ("body", "html") and tag not in ARTICLE:
        box = FOREIGN if names & FOREIGN_WORDS else BESIDE if names & BESIDE_WORDS else 0
    return -1 if tag in ARTICLE or "role:main" in names else 0, box


def tag_end(page: str, at: int) -> int:
    """Behind the ">" that ends the tag whose attributes begin at `at`; one in quotes ends nothing. -1 if there is none."""
    while m := STOP.search(page, at):
        if m[0] == ">":
            return m.end()
        quote = page.find(m[0], m.end())
        at = quote + 1 if quote >= 0 else m.end()
    return -1


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, in time linear in its length. Comments, scripts, styles and other raw elements are no text; character
    references are decoded; white space inside a block, line breaks too, is one space. Unclosed elements end with what holds them. A link that ends
    before the next begins holds over blocks, another ends with its block. From a
    tag on that quotes never let end, tags end at their first ">"; a "<" that begins no tag is text."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # open containers, their kinds and boxes
    open_tags: Counter = Counter()
    parts: list[tuple[str, bool]] = []
    links = tags = barred = article = hidden = headings = foreign = beside = boxes = 0
    quotes = True
    ahead = {"</a": -1, "<a": -1}

    def next_of(mark: str, at: int) -> int:
        """Where the next begin or end of a link stands; every part of the page is searched once."""
        while ahead[mark] < at:
            m = LINK[mark].search(page, at)
            ahead[mark] = m.start() if m else len(page)
        return ahead[mark]

    def close() -> None:
        nonlocal tags
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text and not hidden:
                linked = " ".join(p for p, link in parts if link)
                own = text.split()
                notice = sum(w.strip(".,!?:;()").lower() in NOTICE_WORDS for w in own)
                out.append(Block(text, len(own), len(linked.split()) if linked else 0, tags, barred, int(article > 0), int(headings > 0), int(foreign > 0), boxes if beside else -1, notice))
            parts.clear()
        tags = 0

    def count(tag: str, kind: int, box: int, by: int) -> None:
        nonlocal barred, article, hidden, headings, foreign, beside, boxes
        boxes += box == BESIDE and by > 0 and not beside
        foreign += by * (box == FOREIGN)
        beside += by * (box == BESIDE)
        open_tags[tag] += by
        headings += by * (tag in HEADINGS)
        if kind == 1:
            barred += by
        elif kind == 2:
            hidden += by
        elif kind == -1:
            article += by

    def pop() -> str:
        tag, kind, box = stack.pop()
        count(tag, kind, box, -1)
        return tag

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            parts.append((entities.unescape(page[at:start]), links > 0))
        if start == n:
            break
        at = start + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith("![CDATA[", at):
            end = page.find("]]>", at)
            parts.append((page[at + 8 : end if end >= 0 else n], links > 0))
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("!", "?"), at):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else n
            continue
        name = NAME.match(page, at)
        end = -1
        if name:
            end = tag_end(page, name.end()) if quotes else page.find(">", name.end()) + 1 or -1
            if end < 0 and quotes:
                quotes = False
                end = page.find(">", name.end()) + 1 or -1
        if end < 0:
            if name:  # no tag ends any more
                parts.append((entities.unescape(page[start:]), links > 0))
                break
            parts.append(("<", links > 0))
            continue
        closing, tag, attributes, at = name[0][0] == "/", name[0].lstrip("/").lower(), page[name.end() : end - 1], end
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                shut = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = page.find(">", shut.end() - 1) + 1 or n if shut else n
            continue
        if tag == "br":
            parts.append((" ", False))
            tags += 1
            continue
        if tag in BLOCKS:
            close()
            links = 0 if links == 1 else links
        else:
            tags += not closing
        if tag == "a":
            links = 0 if closing else 2 if next_of("</a", at) < min(next_of("<a", at), n) else 1
        if tag in VOID or tag not in CONTAINERS:
            continue
        if not closing:
            if tag in BLOCKS and stack and stack[-1][0] == "p":
                pop()
            if tag == "li" and stack and stack[-1][0] == "li":
                pop()
            kind, box = kind_of(tag, attributes, article)
            stack.append((tag, kind, box))
            count(tag, kind, box, 1)
        elif open_tags[tag] > 0:
            while pop() != tag:
                pass
    close()
    return out


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "tag_density", "heading", "article", "article_on_page", "notice_density", "foreign", "foreign_share", "box_words", "box_density")


def describe(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; beyond the first and last block counts are 0. foreign_share is the share of the page's words that foreign
    boxes hold; box_words and box_density are of the whole box beside the article that a block stands in, 0 where it is in none."""
    n = len(blocks)
    words = np.array([0, *(min(b.words, 1000) for b in blocks), 0], float)
    density = np.array([0, *(b.linked / b.words for b in blocks), 0], float)
    free = [b for b in blocks if not b.barred]
    anywhere = float(any(b.article for b in free))
    foreign = sum(b.words for b in free if b.foreign) / max(1, sum(b.words for b in free))
    held, linked = Counter(), Counter()
    for b in blocks:
        if b.box >= 0:
            held[b.box] += b.words
            linked[b.box] += b.linked
    rest = np.array([[b.tags / b.words, b.heading, b.article, anywhere, b.notice / b.words, b.foreign, foreign, min(held[b.box], 1000), linked[b.box] / max(1, held[b.box])] for b in blocks], float).reshape(n, 9)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], rest])


# -- the labelled table

#: Pages of the labelled table. A text begins with 1 where it is part of the article, else with 0. {n} becomes n invented words, {a} a link of one word,
#: {ln} a link of n words, {cn} a notice of n words, {mn} n words with a notice's word here and there.
TEASERS = "<ul><li>0{l7}</li><li>0{l5}</li><li>0{l9}</li></ul>"
MENU, LINKS = "<ul><li>0{a}</li><li>0{a}</li><li>0{a}</li><li>0{a}</li></ul>", "<div>0{a} {a} {a}</div>"
LAYOUTS = [
    # an article element, with and without other things around and inside it
    "<nav>" + MENU + "</nav><div>0{8}</div><article><h1>1{9}</h1><p>1{40}</p><p>1{4}</p><p>1{90}</p></article><footer>0{3} {a}</footer>",
    "<nav>" + MENU + "</nav><div>0{12}</div><article><h1>1{6}</h1><p>1{7}</p><p>1{3}</p></article><footer>0{12}</footer>",
    "<header>0{5}</header><main><h1>1{3}</h1><p>1{2}</p><p>1{25} {a} {9}</p></main><aside>0{30}</aside><footer>0{12}</footer>",
    "<article><header><h1>1{7}</h1></header><p>1{18}</p><ul><li>1{6}</li><li>1{9}</li></ul><form>0{5}<p>0{9}</p></form></article><div>0{33}</div><div>0{5}</div>",
    "<article><h1>1{4}</h1><p>1{3}</p><p>1{50}</p><p>1{2}</p><p>1{4}</p></article><div>0{6}</div><div>0{20}</div>",
    "<main><p>1{30}</p><p>1{2}</p><p>1{3}</p></main><div>0{25}</div><div>0{3}</div>",
    "<article><p>1{a}</p><p>1{20}</p><p>1{a} {12}</p></article>",
    "<article><p>1{2}</p></article>",
    "<article><p>1{1}</p><p>1{15}</p><blockquote>1{20}</blockquote><p>1{2}</p></article>" + LINKS + "<p>0{10} {a}</p>",
    "<main><article><h2>1{4}</h2><p>1{a} {a} {13}</p><p>1{30}</p><figure><figcaption>1{8}</figcaption></figure></article></main><p>0{6}</p>",
    "<article><h1>1{6}</h1><p>1{45}</p><p>1{5}</p><p>1{38}</p>" + MENU + "</article>",
    MENU + "<div>0{7}</div><article><h1>1{8}</h1><p>1{3}</p><p>1{11}</p><p>1{2}</p><p>1{70}</p><p>1{6}</p></article><div>0{10}</div>",
    LINKS + "<div>0{15}</div><div>0{40}</div><article><p>1{5}</p><p>1{12}</p><p>1{33}</p></article><div>0{45}</div><div>0{22}</div>",
    MENU + "<article><h1>1{10}</h1><p>1{14}</p><p>1{9}</p></article>" + LINKS,
    "<article><h1>1{5}</h1><p>1{60}</p><p>1{30}</p>" + LINKS + "<div>0{a} {a}</div></article><div>0{14}</div>",
    # an article element that holds other things: related links, link lists, notices, adverts, comments
    "<article><h1>1{6}</h1><p>1{40}</p><p>1{22} {a} {9}</p><h2>0{2}</h2>" + TEASERS + "<p>1{35}</p><p>1{6}</p></article>",
    "<article><p>1{5}</p><p>1{30}</p>" + TEASERS + "<p>1{4}</p><p>1{l2} {14}</p><p>1{50}</p></article><div>0{9}</div>",
    "<article><div>0{c9}</div><h1>1{5}</h1><p>1{33}</p><p>1{m40}</p><p>1{4}</p><p>0{c14} {a}</p></article>",
    "<article><h1>1{4}</h1><p>0{c20}</p><p>1{m60}</p><p>1{m25}</p><p>1{8}</p><div>0{c7} {a} {a}</div></article>",
    "<main><p>0{c12} {l2}</p><p>1{7}</p><p>1{44}</p><p>0{c5}</p></main>",
    '<article><h1>1{5}</h1><p>1{25}</p><div class="ad">0{12}</div><p>1{12}</p><div class="advert-box"><p>0{40}</p><p>0{6}</p></div><p>1{50}</p><p>1{60}</p><p>1{70}</p></article>',
    '<article><h1>1{5}</h1><p>1{60}</p><p>1{3}</p><p>1{80}</p><p>1{45}</p><div id="comments"><p>0{15}</p><p>0{55}</p><p>0{3}</p></div></article>',
    '<div><p>1{70}</p><p>1{90}</p><p>1{40}</p><div class="comment">0{20}</div><div class="comment">0{45}</div></div>',
    '<div class="ads"><p>1{70}</p><p>1{30}</p><p>1{4}</p><p>1{55}</p></div>' + LINKS,
    '<div id="comments"><h1>1{5}</h1><p>1{60}</p><p>1{25}</p></div>',
    '<article><h1>1{5}</h1><p>1{60}</p><div class="related"><p>0{3}</p><p>0{l6}</p><p>0{l8}</p></div><p>1{40}</p><div class="share">0{4}</div></article>',
    '<article><h1>1{5}</h1><p>1{60}</p><div class="newsletter promo"><p>0{5}</p><p>0{12}</p></div><p>1{4}</p><div class="cookie banner">0{10} {a}</div></article>',
    '<article><h1>1{5}</h1><p>1{50}</p><div class="related work"><h2>1{3}</h2><p>1{60} {a} {9}</p><p>1{8}</p><p>1{75}</p></div><p>1{30}</p></article>',
    '<article><h1>1{5}</h1><section class="notice"><p>1{70}</p><p>1{35} {a} {20}</p></section><section class="social"><h2>1{2}</h2><p>1{80}</p><p>1{5}</p></section></article>',
    '<div class="banner"><h1>1{5}</h1><p>1{80}</p><p>1{45}</p></div><div class="promo">0{14}</div>' + LINKS,
    "<article><h1>1{5}</h1><ul><li>1{5}</li><li>1{3} {a} {8}</li><li>1{9}</li></ul><p>1{12} {l3} {5}</p><ul><li>0{l4}</li><li>0{l7}</li><li>0{l5}</li></ul></article>",
    "<article><p>1{30}</p><p>1{3}</p><p>1{20}</p><div>0{l9}</div><p>1{18}</p><div>0{l5} {l4}</div></article><div>0{20}</div>",
    # no such element: word counts and links tell
    LINKS + "<div>1{70}</div><div>1{50}</div><div>1{12}</div><div>1{80}</div>" + LINKS,
    MENU + "<h1>1{6}</h1><p>1{34}</p><p>1{51}</p><h2>1{4}</h2><p>1{47}</p><p>1{8}</p><p>1{66}</p>" + MENU + "<div>0{5}</div>",
    "<div>0{3}</div>" + MENU + "<div>0{10}</div><h1>1{7}</h1><p>1{42}</p><p>1{29}</p><p>1{15}</p><p>1{55}</p><div>0{4}</div>" + LINKS,
    LINKS + "<p>1{44}</p><ul><li>1{7}</li><li>1{5}</li><li>1{9}</li></ul><p>1{61}</p><div>0{2} {a}</div><div>0{a}</div>",
    "<div>0{a}</div><div>0{6}</div><p>1{55}</p><p>1{48}</p><p>1{3}</p><p>1{62}</p><table><tr><td>0{a}</td><td>0{a}</td></tr></table>",
    MENU + "<p>1{24} {a} {15}</p><p>1{31} {a} {a} {22}</p><p>1{a} {30}</p>" + MENU + "<div>0{9}</div>",
    "<div>0{2}</div>" + LINKS + "<h1>1{5}</h1><div>0{3} {a}</div><p>1{70}</p><p>1{26}</p><div>0{6} {a} {a}</div>" + LINKS + "<div>0{7}</div>",
    "<h1>1{6}</h1><p>1{20}</p><p>1{33}</p><p>1{6}</p><p>1{41}</p>",
    "<p>1{a} {30}</p><p>1{45}</p><div>0{a} {a}</div>",
    "<p>1{12}</p><p>1{3}</p>",
    "<p>1{2}</p>",
    "<div>1{4}</div>",
    "<p>1{40}</p><div>0{a}</div><p>1{20}</p>",
    MENU + "<div>1{90}</div>" + MENU,
    MENU + "<div>0{8}</div>" + MENU + "<p>1{52}</p><p>1{4}</p><p>1{37}</p>" + LINKS + "<div>0{11}</div>",
]
#: What composed articles are made of, and what stands in them and around them.
PARTS = ["<p>1{%d}</p>", "<p>1{%d}</p>", "<p>1{%d}</p>", "<p>1{%d}</p>", "<p>1{%d} {a} {9}</p>", "<p>1{l2} {%d}</p>", "<p>1{m%d}</p>", "<ul><li>1{%d}</li><li>1{6}</li></ul>", "<h2>1{4}</h2>", "<blockquote>1{%d}</blockquote>", '<div class="related work"><p>1{70} {a} {20}</p><p>1{%d}</p></div>']
INSERTS = [TEASERS, "<h2>0{2}</h2>" + TEASERS, "<p>0{c12}</p>", "<div>0{c9} {a}</div>", "<p>0{c20} {l2}</p>", '<div class="ad">0{12}</div>', '<div class="advert"><p>0{30}</p><p>0{5}</p></div>', '<div id="comments"><p>0{25}</p><p>0{5}</p></div>', '<div class="related"><p>0{2}</p><p>0{l6}</p><p>0{l8}</p></div>', '<div class="newsletter">0{9}</div>', LINKS, "<div>0{l8}</div>"]
AROUND = ["<div>0{12}</div>", LINKS, MENU, "<div>0{35}</div>", "<div>0{4} {a}</div>", '<div class="ad">0{14}</div>', "<footer>0{6}</footer>"]
#: Pages of the labelled table.
TABLE_PAGES = 1500


def composed(draw: random.Random) -> str:
    """The layout of a page with an article element: parts of any length in any order, with inserts, and other things around it."""
    body = [draw.choice(PARTS).replace("%d", str(round(draw.choice((1.6, 3, 8, 20, 50, 90)) + 0.4))) for _ in range(draw.randint(1, 9))]
    for _ in range(draw.choice((0, 0, 1, 1, 2, 3))):
        body.insert(draw.randint(0, len(body)), draw.choice(INSERTS))
    if draw.random() < 0.7:
        body.insert(0, "<h1>1{6}</h1>")
    some = lambda: "".join(draw.choice(AROUND) for _ in range(draw.choice((0, 0, 1, 2, 3))))
    tag = draw.choice(("article", "article", "main"))
    return f"{some()}<{tag}>{''.join(body)}</{tag}>{some()}"


def labelled_page(layout: str, draw: random.Random) -> tuple[list[Block], list[int]]:
    """Blocks and labels of a page made from a layout. A block's label rides in its text, as its first word."""
    word = lambda: "".join(draw.choice("abcdefghilmnorstu") for _ in range(draw.randint(2, 9)))
    page = re.sub(r">([01])(?=[{])", r">label\1 ", layout)
    some = lambda n: [word() for _ in range(max(1, round(int(n) * draw.uniform(0.6, 1.5))))]
    mixed = lambda n, share: " ".join(draw.choice(sorted(NOTICE_WORDS)) if draw.random() < share else w for w in some(n))
    page = re.sub(r"\{(\d+)\}", lambda m: " ".join(some(m[1])), page)
    page = re.sub(r"\{l(\d+)\}", lambda m: f'<a href="/{word()}">{" ".join(some(m[1]))}</a>', page)
    page = re.sub(r"\{c(\d+)\}", lambda m: draw.choice(sorted(NOTICE_WORDS)) + " " + mixed(m[1], 0.25), page)
    page = re.sub(r"\{m(\d+)\}", lambda m: mixed(m[1], 0.02), page)
    page = re.sub(r"\{a\}", lambda m: f'<a href="/{word()}">{word()}</a>', page)
    blocks = blocks_of(page)
    return [b._replace(words=max(1, b.words - 1)) for b in blocks], [int(b.text[5]) for b in blocks]


def labelled_table(seed: int = 7, pages: int = TABLE_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of `pages` pages, half of them made from LAYOUTS and half composed, but for those that parsing settles."""
    draw = random.Random(seed)
    xs, ys = [], []
    for i in range(pages):
        blocks, labels = labelled_page(composed(draw) if i % 2 else LAYOUTS[i // 2 % len(LAYOUTS)], draw)
        free = np.array([not b.barred for b in blocks])
        xs.append(describe(blocks)[free])
        ys += [y for y, f in zip(labels, free, strict=True) if f]
    return np.vstack(xs), np.array(ys)


# -- the tree


def grow(x: np.ndarray, y: np.ndarray, depth: int = 14, least: int = 3) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, tree for values up to it, tree beyond), or a leaf (label,)."""
    positive = int(y.sum())
    best = (2 * positive * (len(y) - positive) / len(y) - 1e-9, None, None)
    if depth and best[0] > 0:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            cut = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
            if not cut.any():
                continue
            left, right = ones[:-1], positive - ones[:-1]
            impurity = 2 * (left * (n - left) / n + right * (len(y) - n - right) / (len(y) - n))
            impurity[~cut] = np.inf
            i = int(np.argmin(impurity))
            if impurity[i] < best[0] - 1e-9:
                best = (float(impurity[i]), f, float((v[i] + v[i + 1]) / 2))
    if best[1] is None:
        return (int(2 * positive >= len(y)),)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(node) == 1:
            out[rows] = bool(node[0])
        else:
            low = x[rows, node[0]] <= node[1]
            todo += [(node[2], rows[low]), (node[3], rows[~low])]
    return out


def main_text(page: str, tree: tuple) -> str:
    """The blocks that the tree keeps, in page order, one a line. What a page holds in barred elements alone is no article."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    keep = classify(tree, describe(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k and not b.barred)


def extract_pages(pages: DataFrame, tree: tuple | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html). Null or empty html gives an empty text; repeated rows
    give repeated results; other columns are ignored, whatever their names; an empty table gives no rows. Whole pages are read, however long, and nothing of a kept
    block is dropped."""
    tree = tree or grow(*labelled_table())
    kind = pages.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [main_text(h or "", tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
