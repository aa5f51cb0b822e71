"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of its block elements; inline markup is part of the block it stands in. Each block has features:
tag, attribute tokens, depth, text, link and punctuation density of its subtree, its siblings and its ancestors. Boosted
trees give the log odds that it is main text. Decoding takes the best choice for the whole tree under one rule: what is
below a block taken as main is main, what is below one taken as boilerplate is boilerplate, and only below a block left
open do the children choose. So no block contradicts its ancestors. Elements that can't hold an article (scripts, styles,
buttons and the like) are left out before, up to where they end or an enclosing block does; forms are blocks.

The trees are fitted on ``TRAINING_PAGES`` pages made by :func:`example_page`, in which the article is known; no crawled
pages are used.

Defined results: null and empty pages give the empty text. Unclosed, crossed and cut-off markup is read as browsers
close it. Pages are read whole. White space is space and U+0009 to U+000D. Rows that repeat an id are read each. Only
the id, url and html columns are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm import boosting

# Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("script style noscript template title iframe svg math button select textarea object canvas audio video datalist dialog".split())
RAW = frozenset("script style title iframe textarea".split())  # hold no elements
FOREIGN = frozenset("svg math".split())
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small"
    " span strong strike sub sup table tt u ul var".split()
)
HTML_IN_FOREIGN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
ENDS_SELECT = frozenset("select input textarea button".split())
HEAD = frozenset("head base basefont bgsound link meta".split())  # besides those left out; they add nothing to the tree
CELLS = frozenset("caption tbody td tfoot th thead tr".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_PARAGRAPH = BLOCKS - frozenset("html body tbody td tfoot th thead tr caption".split())
SIBLING_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
GROUPS = {
    "menu": ("nav", "menu", "breadcrumb", "pagination", "pager", "toc", "topbar", "skip"),
    "frame": ("header", "footer", "foot", "masthead", "copyright", "legal", "bottom", "branding", "logo"),
    "side": ("sidebar", "side", "aside", "widget", "related", "recommended", "popular", "archive", "tags", "trending"),
    "advert": ("ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "promoted"),
    "notice": ("cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "alert", "newsletter", "subscribe", "signup", "login", "form", "search"),
    "talk": ("comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "reviews", "share", "social"),
    "main": ("article", "main", "content", "post", "entry", "story", "body", "text", "page"),
}
TAGS = ("p", "div", "li", "ul", "h1", "h2", "td", "section", "article", "main", "nav", "aside", "header", "footer", "blockquote", "pre", "form")
WHITE = re.compile(r"[\x20\x09-\x0D]+")
TRAINING_PAGES, OPEN_COST = 1000, 1.0
RIGHTS = re.compile(r"\u00a9|\b[Cc]opyright\b|\(c\) ?[12][0-9]{3}")
ARTICLE = "\ue000"  # marks article text in made-up pages; no page has it


class Block:
    __slots__ = ("tag", "tokens", "parent", "depth", "runs", "children", "links", "inline", "order", "place")

    def __init__(self, tag: str, tokens: frozenset[str], parent: Block | None, order: int):
        self.tag, self.tokens, self.parent, self.order = tag, tokens, parent, order
        self.depth = parent.depth + 1 if parent else 0
        self.runs: list = []  # strings and child blocks, in page order
        self.children: list[Block] = []
        self.links = self.inline = self.place = 0
        if parent:
            self.place = len(parent.children)
            parent.children.append(self)
            parent.runs.append(self)


class Reader(HTMLParser):
    """Builds the tree of blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Block("html", frozenset(), None, 0)
        self.blocks, self.at = [self.root], self.root
        self.open: defaultdict[str, list[Block]] = defaultdict(list)  # open blocks by tag, but for the root
        self.left_out: list[str] = []  # the element left out and those open in it
        self.in_link = 0

    def updatepos(self, i, j):
        """Line numbers aren't needed."""
        return j

    def handle_starttag(self, tag, attrs):
        if self.left_out and not self._ends_left_out(tag):
            if tag not in VOID and (self.left_out[-1] not in RAW or self.left_out[0] in FOREIGN):
                self.left_out.append(tag)
            return
        self.left_out = []
        if tag in HEAD or tag == "form" and self.open["form"]:
            return
        if tag in LEFT_OUT:
            self.left_out.append(tag)
            return
        if tag in ENDS_PARAGRAPH:
            self._end({"p"}, {"td", "th", "table", "button"})
        if tag in SIBLING_ENDS:
            self._end(*SIBLING_ENDS[tag])
        if tag == "html" or tag == "body" and self.open["body"]:
            return
        if tag == "br":
            self.at.runs.append(" ")
        elif tag in BLOCKS:
            self.in_link = 0
            named = dict(attrs)
            words = " ".join(str(named.get(k) or "") for k in ("class", "id", "role")).lower()
            self.at = Block(tag, frozenset(re.split(r"[^a-z]+", words)) - {""}, self.at, len(self.blocks))
            self.blocks.append(self.at)
            if tag in VOID:
                self.at = self.at.parent
            else:
                self.open[tag].append(self.at)
        else:
            self.at.inline += 1
            self.in_link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag not in LEFT_OUT and not (self.left_out and self.left_out[0] in FOREIGN and tag not in ENDS_FOREIGN):
            self.handle_starttag(tag, attrs)

    def _ends_left_out(self, tag: str) -> bool:
        """Whether a start tag ends the element left out."""
        first = self.left_out[0]
        if first in RAW or first == "template":
            return False
        if first in FOREIGN:
            return tag in ENDS_FOREIGN and HTML_IN_FOREIGN.isdisjoint(self.left_out)
        if tag in CELLS and "table" not in self.left_out:
            return any(self.open[t] for t in CELLS)
        return first == "button" and tag == "button" or first == "select" and tag in ENDS_SELECT

    def handle_endtag(self, tag):
        if self.left_out:
            if self.left_out[-1] in RAW and self.left_out[0] not in FOREIGN and tag != self.left_out[-1]:
                return
            if tag in self.left_out:
                while self.left_out.pop() != tag:
                    pass
                return
            if self.left_out[0] == "template" or tag not in BLOCKS or not self.open[tag]:
                return
            self.left_out = []
        if tag in BLOCKS:
            self._end({tag}, set())
        elif tag == "a":
            self.in_link = max(0, self.in_link - 1)

    def handle_data(self, data):
        if not self.left_out and data:
            self.at.runs.append(data)
            if self.in_link:
                self.at.links += len(data.strip())

    def _end(self, tags: set[str], scope: set[str]) -> None:
        """Close the nearest open block of these tags, if no block of ``scope`` stands between."""
        deepest = lambda of: max((self.open[t][-1].depth for t in of if self.open[t]), default=-1)
        depth = deepest(tags)
        if depth > deepest(scope - tags):
            while self.at.depth >= depth:
                self.open[self.at.tag].pop()
                self.at = self.at.parent
            self.in_link = 0


def read_page(html: str | None) -> list[Block]:
    """The blocks of a page in page order; the first is the root."""
    reader = Reader()
    reader.feed(html or "")
    if re.match("<[A-Za-z/!?]", reader.rawdata):  # an unfinished tag or comment at the end of a cut-off page isn't text
        reader.rawdata = ""
    reader.close()
    return reader.blocks


def _bits(masks: list[int], count: int) -> np.ndarray:
    return (np.array(masks, dtype=np.int64)[:, None] >> np.arange(count) & 1).astype(np.float64)


def features(blocks: list[Block]) -> np.ndarray:
    """A row per block."""
    n = len(blocks)
    up = [b.parent.order if b.parent else 0 for b in blocks]
    own, marks, hits, tags, rights = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i, b in enumerate(blocks):
        for r in b.runs:
            if isinstance(r, str):
                own[i] += len(r.strip())
                marks[i] += r.count(",") + r.count(".") + r.count("!") + r.count("?")
                rights[i] += RIGHTS.search(r) is not None
        if b.tokens:
            hits[i] = sum(1 << k for k, words in enumerate(GROUPS.values()) if any(t in words or t.rstrip("s") in words for t in b.tokens))
        tags[i] = 1 << TAGS.index(b.tag) if b.tag in TAGS else 0
    text, link, mark, size, deep = own[:], [b.links for b in blocks], marks[:], [1 + b.inline for b in blocks], [0] * n
    paragraphs = [int(b.tag == "p" and w > 0) for b, w in zip(blocks, own)]
    for i in range(n - 1, 0, -1):
        p = up[i]
        for sums in (text, link, mark, size, paragraphs, rights):
            sums[p] += sums[i]
        deep[p] = max(deep[p], deep[i] + 1)
    path_hits, path_tags = hits[:], tags[:]
    for i in range(1, n):
        path_hits[i] |= path_hits[up[i]]
        path_tags[i] |= path_tags[up[i]]
    family = [len(b.parent.children) if b.parent else 1 for b in blocks]
    alike: list[dict] = [{} for _ in blocks]
    for b in blocks[1:]:
        of = alike[b.parent.order]
        of[b.tag] = of.get(b.tag, 0) + 1
    same = [alike[b.parent.order][b.tag] if b.parent else 1 for b in blocks]
    before = [b.parent.children[b.place - 1].order if b.place else i for i, b in enumerate(blocks)]
    after = [b.parent.children[b.place + 1].order if b.parent and b.place + 1 < len(b.parent.children) else i for i, b in enumerate(blocks)]
    own_, text_, link_, mark_, size_, para_, family_ = (np.array(v, dtype=np.float64) for v in (own, text, link, mark, size, paragraphs, family))
    full, total, logs = np.maximum(text_, 1), max(text[0], 1), np.log1p(text_)
    linked = link_ / full
    columns = [
        [b.depth for b in blocks], deep, np.log1p(own_), logs, text_ / total, linked, mark_ / full * 100, np.log1p(text_ / size_), np.log1p(size_),
        para_, [len(b.children) for b in blocks], family_, [b.place for b in blocks] / family_, same / family_, logs[before], logs[after],
        linked[before], linked[after], text_ / full[up], logs[up], linked[up], para_[up], (np.cumsum(own_) - own_) / total, np.minimum(rights, 2), np.array(rights) * 40 / (40 + full),
    ]
    groups = len(GROUPS)
    return np.column_stack([*columns, _bits(hits, groups), _bits(path_hits, groups), _bits(tags, len(TAGS)), _bits(path_tags, len(TAGS))])


def decode(blocks: list[Block], odds: np.ndarray) -> list[bool]:
    """Whether each block is main text, by the best consistent choice; text is what makes a block count."""
    n = len(blocks)
    weight = [1.0 + any(isinstance(r, str) and r.strip() for r in b.runs) for b in blocks]
    log_main, log_not = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    main, other = log_main * weight, log_not * weight
    open_ = np.full(n, -OPEN_COST)
    for b in blocks:  # text right in an open block is left to that block's own odds
        if weight[b.order] > 1:
            open_[b.order] += max(log_main[b.order], log_not[b.order])
    for b in reversed(blocks):
        if b.parent:
            i, p = b.order, b.parent.order
            open_[p] += max(main[i], other[i], open_[i])
            main[p] += main[i]
            other[p] += other[i]
    state: list[str] = []
    for b in blocks:
        above = state[b.parent.order] if b.parent else "open"
        i = b.order
        if above != "open":
            state.append(above)
        elif b.children and open_[i] > max(main[i], other[i]):
            state.append("open")
        else:
            state.append("main" if main[i] > other[i] else "other")
    return [s == "main" or s == "open" and odds[i] > 0 for i, s in enumerate(state)]


def assemble(root: Block, keep: list[bool]) -> str:
    """Texts of the kept blocks; a block ends where a block begins or ends."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = WHITE.sub(" ", "".join(held)).strip(" ")
        held.clear()
        if text:
            out.append(text)

    stack: list[tuple[Block, int]] = [(root, 0)]
    while stack:
        block, k = stack.pop()
        while k < len(block.runs) and isinstance(block.runs[k], str):
            if keep[block.order]:
                held.append(block.runs[k])
            k += 1
        flush()
        if k < len(block.runs):
            stack += [(block, k + 1), (block.runs[k], 0)]
    return "\n".join(out)


def example_page(draw: np.random.Generator) -> str:
    """A made-up page; the article's texts begin with U+E000, so that labels survive any reading of the markup."""
    chance = lambda p: draw.random() < p
    pick = lambda of: of[int(draw.integers(len(of)))]
    syllables = ("the", "ou", "ment", "ing", "er", "cion", "lich", "que", "an", "st", "re", "bo", "a", "le")
    word = lambda: "".join(pick(syllables) for _ in range(int(draw.integers(1, 4))))

    def words(least: int, most: int) -> str:
        ends = ("", "", "", "", ",", ".", "%%%", "###") if chance(0.2) else ("", "", "", "", "", "", ",", ".")
        return " ".join(word() + pick(ends) for _ in range(int(draw.integers(least, most + 1)))).capitalize() + pick((".", ".", "", "!"))

    def links(least: int, most: int) -> str:
        item = pick(("<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> ", "<li><a href='/x'>{}</a> <span>|</span></li>"))
        inner = "".join(item.format(word() if chance(0.7) else words(2, 6)) for _ in range(int(draw.integers(least, most + 1))))
        return f"<ul>{inner}</ul>" if "<li>" in item else inner

    def box(names: tuple[str, ...], tags: tuple[str, ...], inner: str) -> str:
        tag = pick(tags)
        named = "" if tag not in ("div", "section", "p", "ul") and chance(0.6) else f' {pick(("class", "id"))}="{pick(names)}{pick(("", "", "-box", " wrap", "_1"))}"'
        return f"<{tag}{named}>{inner}</{tag}>"

    prose = lambda: "".join(f"<p>{words(3, 40)}</p>" for _ in range(int(draw.integers(1, 4)))) if chance(0.5) else words(3, 30)
    advert = lambda: box(("ad", "ads", "advert", "banner", "sponsored", "promo"), ("div", "aside", "section"), prose() if chance(0.7) else links(1, 3))
    above = [
        lambda: box(("nav", "menu", "main-menu", "navbar", "breadcrumb"), ("nav", "nav", "div", "ul"), links(1, 9) if chance(0.85) else words(1, 6)),
        lambda: box(("header", "masthead", "branding", "topbar"), ("header", "div"), f"<h2>{words(1, 4)}</h2>" + (words(2, 8) if chance(0.5) else links(2, 5))),
        lambda: box(("cookie", "cookie-notice", "consent", "notice", "alert"), ("div", "section", "aside"), prose()),
        advert,
        lambda: box(("search", "login", "subscribe"), ("div", "section"), words(2, 8) + "<form><input> " + words(1, 4) + "</form>"),
    ]
    below = [
        lambda: box(("sidebar", "widget", "related", "popular", "side"), ("aside", "aside", "div", "section"), f"<h3>{words(1, 3)}</h3>" + (links(2, 8) if chance(0.6) else prose())),
        lambda: box(("comments", "comment-list", "discussion", "respond", "replies"), ("section", "div"), f"<h3>{words(1, 3)}</h3>" + "".join(box(("comment", "reply"), ("div", "article", "li"), f"<b>{word()}</b> " + prose()) for _ in range(int(draw.integers(1, 6))))),
        lambda: box(("share", "social", "tags"), ("div", "ul"), links(2, 6)),
        advert,
        lambda: box(("newsletter", "signup", "popup"), ("div", "section"), words(4, 20)),
    ]
    foot = lambda: box(("footer", "foot", "copyright", "legal", "bottom"), ("footer", "footer", "footer", "div"), ("&copy; " + words(2, 16)) if chance(0.7) else prose() + links(1, 6))
    mine = lambda least, most: ARTICLE + words(least, most)

    def article() -> str:
        close = "</p>" if chance(0.85) else ""
        parts = [f"<h1>{mine(1, 10)}</h1>"] if chance(0.85) else []
        if parts and chance(0.1):
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(int(pick((0, 1, 1, 2, 3, 5, 8, 14)))):
            kind = int(draw.integers(14))
            if kind < 7:
                parts.append(f"<p>{mine(1, 90)}{close}")
            elif kind == 7:
                parts.append(f"<p><b>{mine(2, 14)}<br>")
            elif kind == 8:
                parts.append("<p>" + mine(3, 20) + f" <a href='/y'>{word()}</a> <em>{words(1, 6)}</em>{close}")
            elif kind == 9:
                parts.append("<ul>" + "".join(f"<li>{mine(1, 14)}</li>" for _ in range(int(draw.integers(1, 6)))) + "</ul>")
            elif kind == 10:
                parts.append(pick(("<blockquote>{}</blockquote>", "<pre>{}</pre>", "<h2>{}</h2>", "<h3>{}</h3>", "<div>{}</div>")).format(mine(1, 25)))
            elif kind == 11:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{mine(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(int(draw.integers(1, 4)))) + "</table>")
            elif kind == 12:
                parts.append(f"<figure><img src='z'><figcaption>{mine(2, 10)}</figcaption></figure>")
            elif chance(0.5):
                parts.append(pick((above[3], below[2], below[0]))())
        if not any(ARTICLE in p for p in parts):
            parts.append(f"<p>{mine(1, 40)}{close}")
        return "".join(parts)

    tag, named = pick((("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="post-content"'), ("div", ' class="entry"'), ("div", ' id="content"'), ("section", ' class="story"'), ("div", ' class="article-body"'), ("div", "")))
    if chance(0.15):  # next to nothing on the page
        small = lambda t: f"<{t}>{word()}</{t}>"
        parts = [f"<{tag}{named}>" + "".join(f"<p>{mine(1, 5)}" for _ in range(int(draw.integers(1, 4)))) + f"</{tag}>"]
        parts += [small(t) for t in ("nav", "aside", "footer") if chance(0.5)]
        return (small("nav") if chance(0.3) else "") + (small("header") if chance(0.3) else "") + "".join(parts)
    top = "".join(pick(above)() for _ in range(int(draw.integers(0, 4))))
    low = "".join(pick(below)() for _ in range(int(draw.integers(0, 4))))
    inside = below[1]() if chance(0.15) else ""
    body = top + f"<{tag}{named}>{article()}{inside}</{tag}>" + low
    if chance(0.15):  # laid out by a table: a bar above, links beside, a line below
        cell = lambda of: f"<td{pick(('', ' width=150', ' valign=top', ' bgcolor=#eeeeee'))}>{of}</td>"
        bar = f"<tr>{pick(('<td colspan=2>{}</td>', '<td colspan=3><b>{}</b></td>', '<td colspan=2><h1>{}</h1></td>', '<td colspan=2><font size=5>{}</font></td>')).format(words(1, 6))}</tr>"
        side = cell(pick((lambda: links(2, 9), lambda: "<br>".join(f"<a href='/x'>{word()}</a>" for _ in range(int(draw.integers(2, 9)))), lambda: f"<b>{words(1, 3)}</b><br>" + links(2, 5)))())
        middle = cell(pick(("{}", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>")).format(article()))
        line = f"<tr><td colspan=2>{pick(('<small>{}</small>', '<center>{}</center>', '{}', '<p>{}</p>')).format(pick(('&copy; ', 'Copyright ', '')) + words(2, 12))}</td></tr>"
        cells = side + middle if chance(0.7) else middle + side if chance(0.5) else middle
        return f"<html><head><title>{words(2, 8)}</title></head><body>{top if chance(0.2) else ''}<table>{bar if chance(0.8) else ''}<tr>{cells}</tr>{line if chance(0.8) else ''}</table>{foot() if chance(0.2) else ''}</body></html>"
    if chance(0.1):
        body = pick(("<form>{}</form>", '<form id="form1" action="/">{}</form>')).format(body)
    if chance(0.4):
        body = pick(('<div class="wrap">{}</div>', "<div>{}</div>", "<main>{}</main>", '<div id="page"><div>{}</div></div>')).format(body)
    body += foot() if chance(0.9) else ""
    if chance(0.25):  # names that say nothing
        names: dict[str, str] = {}
        hashed = lambda m: m[1] + names.setdefault(m[2], pick(("css-", "sc-", "_", "x")) + "".join(pick("abcdefghjkmnqrstvwxyz0123456789") for _ in range(6))) + m[3]
        body = re.sub(r"""((?:class|id)=")([^"]*)(")""", hashed, body)
        if chance(0.5):
            body = re.sub(r"<(/?)(?:header|footer|aside|section|article|main)\b", r"<\1div", body)
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{body}</body></html>"


@cache
def fit(pages: int = TRAINING_PAGES, seed: int = 5) -> boosting.Trees:
    """Trees over the blocks of made-up pages; blocks that hold both kinds of text, or none, are left out.

    The same arguments always give the same trees, fitted once a process.
    """
    draw = np.random.default_rng(seed)
    rows, labels = [], []
    for _ in range(pages):
        blocks = read_page(example_page(draw))
        mine, rest = [0] * len(blocks), [0] * len(blocks)
        for b in blocks:
            text = "".join(r for r in b.runs if isinstance(r, str)).strip()
            mine[b.order] += ARTICLE in text
            rest[b.order] += bool(text) and ARTICLE not in text
        for b in reversed(blocks[1:]):
            mine[b.parent.order] += mine[b.order]
            rest[b.parent.order] += rest[b.order]
        for row, m, r in zip(features(blocks), mine, rest):
            if bool(m) != bool(r):
                rows.append(row)
                labels.append(bool(m))
    return boosting.fit(np.array(rows), np.array(labels, dtype=float), trees=60, depth=5)


def main_texts(trees: boosting.Trees, pages: list[str | None]) -> list[str]:
    read = [read_page(p) for p in pages]
    every = [features(b) for b in read]
    odds = trees.margin(np.concatenate(every)) if every else np.zeros(0)
    out, at = [], 0
    for blocks in read:
        out.append(assemble(blocks[0], decode(blocks, odds[at : at + len(blocks)])))
        at += len(blocks)
    return out


def extract(pages: DataFrame, trees: boosting.Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = 128) -> DataFrame:
    """id, url and main text of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(trees.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = boosting.Trees(*shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, group):
                part = batch.slice(first, group)
                texts = main_texts(own, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string").withColumnsRenamed({"id": id_col, "url": url_col})
