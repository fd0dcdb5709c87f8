"""Main text of web pages by text-to-tag ratios over streaming parser events.

The standard library's parser streams tags, a piece of the page at a time. Text between block tags is a line; its ratio is characters
by tags (plus one). Ratios are smoothed over the page with a Gaussian; lines at or above a threshold form the content cluster,
and how far above or below they are is their worth.
The cluster selects regions: every article and main element if one of them has a line of the cluster, or else the container
whose lines have the largest worth in all, so that parts of low ratio stay outside and short lines within stay in. A region gives
all its lines in page order, less those inside parts that are no content by their element or class (menus, notices, adverts,
forms, comments, scripts). Inside an article a listed word beside others that do not belong to page furniture ("related-work")
is only a hint: such a part stays if one of its lines, outside links, is in the content cluster.

Null or empty html gives empty text. Broken markup never fails: unclosed elements end with their parents, unclosed comments,
scripts and declarations with the page, an attribute's quote that never closes is no quote, after a tag without an end outside quotes
no quote counts any more, and the cost stays in proportion to the page. Repeated rows
are kept, ties between regions go to the inner or last one, an empty table gives an empty result, and all input columns pass through;
existing columns named text or n_chars are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tilewright.llm.common import slices

#: Elements that hold no article text; elements that can hold a region; elements of a head, which any other one ends;
#: inline elements, which do not end a line.
SKIP = frozenset("nav footer aside form script style noscript template button select textarea iframe svg canvas dialog menu head title object".split())
CONTAINERS = frozenset("html body main article section div td table blockquote center".split())
UNSEEN = frozenset("script style noscript template head title select textarea iframe svg canvas object".split())
HEAD = frozenset("head title meta link base style script noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_CONTENT = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice "
    "notification popup promo promoted promotion related reply replies share sharing sidebar skyscraper social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: First parts of class names that tell of a part elsewhere ("has-sidebar"); class names of articles that are comments.
MODIFIERS, REMARKS = frozenset("has no with without not".split()), frozenset("comment reply".split())
#: Words for what readers write.
OTHERS = frozenset("comment comments disqus reply replies".split())
#: Words that go with those above in names of page furniture.
FURNITURE = frozenset(
    "a all area article articles bar block body bottom box btn button buttons center col column container content count entry feed field fixed form group head heading home i icon icons id img inner input item items "
    "label latest left link links list main media more mini module news note outer page panel post posts primary right row secondary section signup slot sticky story stories tag tags text thread title top unit video wrap wrapper".split()
)
WIDTH = 1.5
_TOKEN = re.compile(r"[A-Za-z]+")


def _no_content(tag: str, attrs: list, in_article: bool) -> int:
    """1 if a part is no content by its element or name, 2 if its name leaves that to the ratios, else 0."""
    if tag in SKIP or (tag == "header" and not in_article):
        return 1
    named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower().split()
    if tag in ("html", "body", "main", "article"):
        return int(tag == "article" and any(x in REMARKS for x in named))
    if any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs):
        return 1
    listed = [p for p in map(_TOKEN.findall, named) if p and p[0] not in MODIFIERS and any(x in NO_CONTENT for x in p)]
    if not listed:
        return 0
    return 1 if not in_article or any(not OTHERS.isdisjoint(p) or all(x in NO_CONTENT or x in FURNITURE for x in p) for p in listed) else 2


_OPEN = re.compile(r"<(?:[A-Za-z/!?])")
_STOP = re.compile(r"=\s*[\"']|>")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style")}
_RAW_START = re.compile(r"<(script|style)(?=[\s/>])", re.I)


def _tag_end(page: str, at: int, never: set[str]) -> int:
    """Where the tag that starts at `at` ends: the next '>' outside quoted attribute values; -1 if there is no '>'.

    never: quotes that occur no more from some place on, so that each is sought in vain only once in a page.
    """
    j = at + 1
    while m := _STOP.search(page, j):
        j, quote = m.end(), page[m.end() - 1]
        if quote == ">":
            return j
        if quote not in never:
            close = page.find(quote, j)
            if close < 0:
                never.add(quote)
            else:
                j = close + 1
    never.update("\"'")
    return page.find(">", at) + 1 or -1


def pieces(page: str) -> Iterator[tuple[bool, str]]:
    """(is a tag, string) of a page in order, without comments, declarations, scripts and styles; what never ends runs to the end.

    Every search starts behind the last one's end or fails once, so runs of opened and never closed things cost no more than others.
    """
    at, never = 0, set()
    while at < len(page):
        m = _OPEN.search(page, at)
        start = m.start() if m else len(page)
        if start > at:
            yield False, page[at:start]
        if not m:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)  # "<!-->" is a whole comment
            at = end + 3 if end >= 0 else len(page)
        elif page[start + 1] in "!?" or (page[start + 1] == "/" and not page[start + 2 : start + 3].isalpha()):
            at = page.find(">", start) + 1 or len(page)
        elif raw := _RAW_START.match(page, start):
            end = _RAW[raw[1].lower()].search(page, raw.end())
            at = end.start() if end else len(page)
            if end:
                at = page.find(">", at) + 1 or len(page)
        else:
            end = _tag_end(page, start, never)
            if end < 0:
                yield False, page[start:]
                return
            yield True, page[start:end]
            at = end


class _Lines(HTMLParser):
    """Lines as (text, tags, container, whether text is outside links, no content), where containers form a tree of (parent, tag)."""

    CDATA_CONTENT_ELEMENTS = RCDATA_CONTENT_ELEMENTS = ()  # pieces() has left out what is no markup

    def __init__(self, hints: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.hints = hints
        self.lines: list[tuple[str, int, int, bool, bool]] = []
        self.tree: list[tuple[int, str]] = [(-1, "page")]
        self.open: list[tuple[str, int, bool]] = []  # tag, container, no content
        self.count: dict[str, int] = {}
        self.dark = self.articles = self.tags = 0
        self.doubtful: list[int] = []  # containers whose names leave it to the ratios
        self.forms: list[int] = []  # places in open of forms that are no content
        self.text: list[str] = []
        self.link = self.prose = False  # in a link of this line; text outside links in this line

    def read(self, page: str) -> None:
        for is_tag, piece in pieces(page):
            if not is_tag:
                self.handle_data(unescape(piece))
                continue
            try:
                self.feed(piece)
            except AssertionError:  # how the standard parser says that a declaration is malformed
                pass
            self.rawdata = ""  # a tag that the parser finds incomplete
        self.end_line()

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.open[-1][1] if self.open else 0, self.prose, self.dark > 0))
        self.text, self.tags, self.link, self.prose = [], 0, False, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in HEAD and self.count.get("head"):  # its end tag may be left out
            self.handle_endtag("head")
        if tag in ("article", "main") and self.dark and self.dark == len(self.forms):  # a form around the page
            for i in self.forms:
                self.open[i] = ("form", self.open[i][1], False)
            self.dark, self.forms = 0, []
        if tag not in INLINE:
            self.end_line()
        elif tag == "a":
            names = {k for k, _ in attrs}
            self.link = "href" in names or not names & {"id", "name"}
        self.tags += 1
        void = tag in ("br", "hr", "img", "input", "meta", "link", "wbr", "col", "area", "base", "embed", "source", "track", "param")
        verdict = 0 if void else _no_content(tag, attrs, self.articles > 0) if self.hints else tag in UNSEEN
        off = verdict == 1
        if tag in CONTAINERS or verdict:
            at = self.open[-1][1] if self.open else 0
            if verdict == 2:
                self.doubtful.append(len(self.tree))
            self.tree.append((at, tag))
            self.open.append((tag, len(self.tree) - 1, off))
            self.count[tag] = self.count.get(tag, 0) + 1
            self.dark += off
            if off and tag == "form":
                self.forms.append(len(self.open) - 1)
            self.articles += tag in ("article", "main")
        elif tag in self.count and not void:  # an element of a tag that also ends some part: kept to pair the end tags
            self.open.append((tag, self.open[-1][1] if self.open else 0, False))
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.end_line()
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
        elif tag == "a":
            self.link = False
        if self.count.get(tag):
            while self.open:
                name, _, off = self.open.pop()
                self.count[name] -= 1
                self.dark -= off
                if self.forms and self.forms[-1] == len(self.open):
                    self.forms.pop()
                self.articles -= name in ("article", "main")
                if name == tag:
                    break

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        self.prose = self.prose or not (self.link or data.isspace())


def margins(ratios: np.ndarray) -> np.ndarray:
    """How far the smoothed ratio of each line is above the threshold: its spread over the page, at most half its peak."""
    if not len(ratios):
        return np.zeros(0)
    reach = np.arange(-int(3 * WIDTH), int(3 * WIDTH) + 1)
    kernel = np.exp(-(reach**2) / (2 * WIDTH**2))
    n = len(ratios)
    weight = np.convolve(np.ones(n), kernel, mode="full")[int(3 * WIDTH) : int(3 * WIDTH) + n]
    smooth = np.convolve(ratios, kernel, mode="full")[int(3 * WIDTH) : int(3 * WIDTH) + n] / weight
    return smooth - min(smooth.std(), smooth.max() / 2)


def _inside(tree: list[tuple[int, str]], at: list[int], worth: np.ndarray) -> np.ndarray:
    """Sum of the worth of the lines inside each container."""
    n = np.bincount(at, weights=worth, minlength=len(tree))
    for i in range(len(tree) - 1, 0, -1):
        n[tree[i][0]] += n[i]
    return n


def main_text(html: str | None, hints: bool = True) -> str:
    """Text of the content regions. hints: elements and class names that tell of no content are left out."""
    p = _Lines(hints)
    p.read(html or "")
    if not p.lines:
        return ""
    worth = margins(np.array([len(t) / (tags + 1) for t, tags, *_ in p.lines]))
    at = [c for _, _, c, _, _ in p.lines]
    light = np.array([not dark for *_, dark in p.lines])
    prose = np.array([x for *_, x, _ in p.lines])
    if not light.any():
        return ""
    if p.doubtful:
        said = _inside(p.tree, at, (light & prose & (worth >= 0)).astype(float))
        shut = np.zeros(len(p.tree), bool)
        shut[[i for i in p.doubtful if not said[i]]] = True
        for i in range(1, len(p.tree)):  # parents come before their sons
            shut[i] |= shut[p.tree[i][0]]
        light = light & ~shut[at]
        if not light.any():
            return ""
    hit = light & (worth >= 0)
    hit = hit & prose if (hit & prose).any() else hit if hit.any() else light
    inside, lit = _inside(p.tree, at, hit.astype(float)), _inside(p.tree, at, np.where(light & prose, worth, np.minimum(worth, 0)))  # no content and links alone add nothing
    chosen = {i for i, (_, tag) in enumerate(p.tree) if tag in ("article", "main")}
    if not any(inside[i] > 0 for i in chosen):
        chosen = {max((i for i in range(len(p.tree)) if inside[i] > 0), key=lambda i: (round(lit[i], 6), i))}  # sons come after parents
    on = np.zeros(len(p.tree), bool)
    for i in range(len(p.tree)):  # parents come before their sons
        on[i] = i in chosen or (i > 0 and on[p.tree[i][0]])
    return " ".join(line[0] for line, lightly in zip(p.lines, light, strict=True) if lightly and on[line[2]])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text and n_chars (long)."""
    more = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    schema = T.StructType([f for f in pages.schema.fields if f.name not in ("text", "n_chars")] + more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, html):
                found = [main_text(x) for x in batch.column(html).to_pylist()]
                kept = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("text", "n_chars")}
                yield pa.RecordBatch.from_arrays([*kept.values(), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.mapInArrow(run, schema)
