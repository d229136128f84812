"""Main text of web pages by two passes of block rules.

A page falls into blocks at block elements. The first pass judges each block alone: a block in an element that is never
main text (menus, footers, side bars, forms, notices, adverts, reader comments) or that mostly consists of links is bad; a
long block with many stop words is good, and a long one without them is bad where no article element vouches for it; what
is left is short or ambiguous. The second pass lets these inherit from the nearest decided blocks before and behind them in
their part of the page: good where either is good and at least as near as a bad one, good as well where nothing there is
decided. Good blocks are the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Frequent function words of English, French, German, Spanish, Italian, Portuguese and Dutch; a parameter of `extract`.
STOP_WORDS = frozenset(
    """the of and to in a is that it for on with as was at by be this are from or an not but have had his her they which you we were
    le la les de des du un une et en est que qui dans pour sur au aux par pas ne se ce il elle avec plus son sa ou
    der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
    el los las una y por con no para su al lo como más pero sus
    il lo gli che di è per non con del della si da sono
    o os um uma do não em são dos mais
    het een van op te dat zijn voor niet met aan""".split()
)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())  # hold text up to their own end tag
OUT = frozenset("aside button canvas datalist dialog footer form head header menu nav noscript object search select svg template video audio math map".split())
#: Names in class, id or role that mark what is never main text; compared with the words that names consist of.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary consent
    alert contentinfo cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination pager
    popup promo promoted related replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription
    syndication toolbar widget widgets skip toc""".split()
)
IN_HEAD = frozenset("head title meta link base style script noscript template".split())
AROUND = ("article", "main", "table", "td")
COMMENTS = frozenset("comment comments disqus replies respond".split())
LETTERS = re.compile(r"[^\W\d_]+")
ATTRIBUTES = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HUMP, SEPARATORS = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[^a-zA-Z]+")
HIDDEN = re.compile(r"""\shidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.IGNORECASE)

LONG, STOP_DENSITY, LINK_DENSITY = 70, 0.15, 0.5  # characters; share of words; share of characters


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in order; kind is text, open or close. Comments, doctypes and what script, style
    and the like hold are left out. Reads forward only: a quote that nothing closes is no quote for the rest of the page."""
    at, end, quotes = 0, len(html), True
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        if lt > at:
            yield "text", html[at:lt], ""
        nxt = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            to = html.find("-->", lt + 2)
            at = end if to < 0 else to + 3
        elif tag := NAME.match(html, lt + 1 + (nxt == "/")):
            if html.startswith(">", tag.end()):
                to = tag.end() + 1
            else:
                found = ATTRIBUTES.match(html, tag.end()) if quotes else None
                quotes = found is not None
                to = found.end() if found else html.find(">", tag.end()) + 1
            if not to:  # the page breaks off inside a tag
                return
            name = tag.group().lower()
            attributes, at = html[tag.end() : to - 1], to
            if nxt == "/":
                yield "close", name, ""
                continue
            yield "open", name, attributes
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
                at = close.start() if close else end
        elif nxt in ("!", "?", "/"):
            to = html.find(">", lt)
            at = end if to < 0 else to + 1
        else:
            yield "text", "<", ""
            at = lt + 1


def marks(attributes: str) -> set[str]:
    """Which MARKS an element bears: as a whole name of its class, id or role, or as a name's first or last word; names
    that begin with has, with, no or is say what a page holds, not what the element is."""
    out = set()
    for found in MARKED.finditer(attributes):
        for name in next(x for x in found.groups() if x is not None).split():
            for form in (name, HUMP.sub("-", name)):
                words = [w for w in SEPARATORS.split(form.lower()) if w]
                if words and words[0] not in ("has", "with", "no", "is", "without"):
                    out |= {words[0], words[-1]} & MARKS
    return out


class Page:
    """Falls html into blocks: `found` holds text parts, characters in links, part of the page and why it is out, of each."""

    def __init__(self, html: str):
        self.found: list[tuple[list[str], list[int], int, str]] = []
        self.open: list[tuple[str, str, int]] = []  # element, why it is out, part of the page
        self.where: dict[str, list[int]] = {"": []}  # places in open of each element; of those that are blocks but no paragraph under ""
        self.links, self.articles = 0, 0
        self.begin()
        for kind, name, attributes in tokens(html):
            if kind == "text":
                self.parts.append(name)
                if self.links:
                    self.linked.append(len(name.strip()))
            elif kind == "open":
                self.enter(name, attributes)
            else:
                self.leave(name)
        self.begin()

    def state(self) -> tuple[str, int]:
        return self.open[-1][1:] if self.open else ("", -1)

    def begin(self) -> None:
        self.parts, self.linked = [], []
        self.now = self.state()
        if not self.found or self.found[-1][0]:
            self.found.append((self.parts, self.linked, self.now[1], self.now[0]))
        else:
            self.found[-1] = (self.parts, self.linked, self.now[1], self.now[0])

    def innermost(self, name: str) -> int:
        return (self.where.get(name) or [-1])[-1]

    def close_to(self, place: int) -> None:
        while len(self.open) > place:
            name = self.open.pop()[0]
            self.where[name].pop()
            if name in BLOCKS and name != "p":
                self.where[""].pop()

    def enter(self, name: str, attributes: str) -> None:
        if name == "a":
            self.links = 1
        if name == "br":
            self.parts.append(" ")
        block = name in BLOCKS
        if self.where.get("head") and name not in IN_HEAD:
            self.close_to(self.innermost("head"))
        if block and (place := self.innermost("p")) > self.innermost(""):  # a block ends a paragraph left open
            self.close_to(place)
        why, part = self.state()
        own = marks(attributes) if attributes else set()
        if name in ("article", "main") and not own and why != "comments":
            if part < 0:  # an article begins anew in whatever was left open
                self.articles += 1
                part, why = self.articles, ""
        elif not why and name not in ("html", "body"):
            if own & COMMENTS:
                why = "comments"
            elif name in RAW or (name in OUT and not (name == "header" and part > 0)):
                why = name
            elif own or (attributes and HIDDEN.search(attributes)):
                why = "mark"
        if name not in VOID:
            self.where.setdefault(name, []).append(len(self.open))
            if block and name != "p":
                self.where[""].append(len(self.open))
            self.open.append((name, why, part))
        if block or self.state() != self.now:
            self.begin()

    def leave(self, name: str) -> None:
        if name == "a":
            self.links = 0
        if (place := self.innermost(name)) >= 0 and (name in AROUND or place > max(map(self.innermost, AROUND))):
            self.close_to(place)  # a stray end tag closes nothing around an article or a cell
        if name in BLOCKS or self.state() != self.now:
            self.begin()


def blocks(html: str) -> list[tuple[str, int, int, str]]:
    """(text, characters in links, part of the page, why it is out or "") of each block with text, in page order. A part
    is an article or main element, -1 is all else."""
    out = []
    for parts, linked, part, why in Page(html).found:
        raw = "".join(parts)
        if text := " ".join((unescape(raw) if "&" in raw else raw).split()):
            out.append((text, sum(linked), part, why))
    return out


def first_pass(text: str, linked: int, part: int, out: str, stop_words: frozenset[str]) -> str:
    """good, bad, or unsure."""
    if out:
        return "bad"
    if linked > LINK_DENSITY * len(text):
        return "bad"
    if len(text) < LONG or linked > LINK_DENSITY / 2 * len(text):
        return "unsure"
    words = LETTERS.findall(text.lower())
    if words and len(list(filter(stop_words.__contains__, words))) >= STOP_DENSITY * len(words):
        return "good"
    return "unsure" if part > 0 else "bad"


def nearest(states: list[str], parts: list[int]) -> list[tuple[int, str]]:
    """How far the nearest decided block before each one is in its part of the page, and its state ("" without one)."""
    last: dict[int, tuple[int, str]] = {}
    out = []
    for i, (state, part) in enumerate(zip(states, parts, strict=True)):
        at, decided = last.get(part, (i, ""))
        out.append((i - at, decided))
        if state != "unsure":
            last[part] = (i, state)
    return out


def second_pass(states: list[str], parts: list[int]) -> list[bool]:
    """Whether each block is text: unsure ones take after the nearest decided ones before and behind them in their part
    of the page; a good one wins a tie, and where none is decided they are text."""
    sides = zip(nearest(states, parts), nearest(states[::-1], parts[::-1])[::-1], strict=True)
    keep = []
    for state, near in zip(states, sides, strict=True):
        if state == "unsure":
            decided = sorted((d, s != "good") for d, s in near if s)
            keep.append(not decided or not decided[0][1])
        else:
            keep.append(state == "good")
    return keep


def main_text(html: str, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The main text of a page: good blocks in page order, joined by one space.

    Blocks that are out are nobody's neighbours, nor are links inside an article, so that neither a menu beside an article
    nor a list of links in it spoils a short paragraph. Where an article element holds text, what stands outside all of
    them is bad. A page all of whose text is in forms or otherwise
    out is judged as if the forms weren't."""
    found = blocks(html)
    if all(out for *_, out in found):
        found = [(text, linked, part, "" if out == "form" else out) for text, linked, part, out in found]
    states = [first_pass(*b, stop_words) for b in found]
    if any(part > 0 and state != "bad" for state, (_, _, part, _) in zip(states, found, strict=True)):
        states = ["bad" if part < 0 else state for state, (_, _, part, _) in zip(states, found, strict=True)]
    parts = [-2 if out or (part > 0 and state == "bad") else part for state, (_, _, part, out) in zip(states, found, strict=True)]
    keep = second_pass(states, parts)
    return " ".join(b[0] for b, good in zip(found, keep, strict=True) if good)


def extract(pages: DataFrame, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages (page_id, url, html).

    Null and empty html, and pages without main text, give an empty text and 0; null page_id and url stay null; repeated
    rows are rows of their own. Pages are read whole, in one pass over each, and rows never meet: no shuffle. Other columns
    are not read."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, stop_words) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
