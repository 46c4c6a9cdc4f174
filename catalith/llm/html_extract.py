"""Main text of web pages by the distribution of text over lines.

The page is read once, by a tolerant scanner whose work is linear in the page:
scripts, styles, comments and the head go, block elements part lines, inline
elements do not.  Then, for every page alike:

1. Lines of menus, page headers and footers, side bars, notices, adverts, forms
   and reader comments, told by their element, role, class or id, are taken
   out; if the page marks articles (``article``, ``main``, ``role=main``,
   ``itemprop=articleBody``) that hold text outside links, so are the lines
   outside all of them.
2. A line's length is its characters outside links; in a marked article all of
   its characters.
3. Lengths are summed over a sliding window of lines.  Where a sum surges to the
   threshold the text starts, where the sums dive to nothing it ends, and the
   lines between are kept, with the headings right above them.  On a page whose
   sums all stay below the threshold, its largest sum is the threshold.

Edge cases: a null or empty page has the text ``''``; broken and unclosed markup
is read as far as it goes (a tag that never ends swallows the rest, as in a
browser); repeated rows each give a row; null ids stay null; an empty table
gives none; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import rowwise

#: Lines in a window, and the characters in one that make a surge.
WINDOW, SURGE = 3, 80

_NAME = re.compile(r"[^\s/>]*+")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z_:-])([a-zA-Z_:-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))")
_RAW = {"script", "style", "textarea", "noscript", "template", "svg", "iframe", "object", "title", "xmp", "math", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_BARE = {"head", "nav", "footer", "aside", "form", "select", "button", "dialog", "menu"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words of a class or an id that name what is not the article.
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advert(?:isement|ising)s?|adsense|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|cookies?|consent|gdpr|notices?|notifications?|alert|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|foot|masthead|toolbar|pagination|pager|comments?|commentlist|disqus|respond|reviews|replies|share|sharing|social|newsletter|subscribe|subscription|signup|login|related|recommended|recommendations|widget|widgets|tags|skip|copyright)(?:$|[\s_-]|\d)",
    re.I,
)
_NOTICE = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-?head|page-?head|topbar)(?:$|[\s_-]|\d)", re.I)


@dataclass
class _Line:
    text: list[str] = field(default_factory=list)
    linked: int = 0
    bare: bool = False
    article: int = 0
    heading: bool = False


class _Element(NamedTuple):
    tag: str
    bare: bool
    #: Inside a structure that no article ends.
    fixed: bool
    article: int
    #: Place of the nearest block element in the stack, itself included.
    block: int


class _Scanner:
    """Tags and the text between them; every step moves on."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.quoted = True  # until a quotation in a tag has swallowed the rest of the page

    def _end(self, at: int) -> int:
        """Where the tag ends whose name stops at ``at``; quotations may hold ``>``."""
        page, i = self.page, at
        while self.quoted and (m := _STOP.search(page, i)):
            if m[0] == ">":
                return m.end()
            close = page.find(m[0], m.end())
            if close < 0:
                break
            i = close + 1
        self.quoted = False
        return page.find(">", at) + 1 or len(page)

    def _past(self, end: str, at: int) -> int:
        found = self.page.find(end, at)
        return len(self.page) if found < 0 else found + len(end)

    def read(self, reader: _Reader) -> None:
        page, low = self.page, None
        while self.at < len(page):
            lt = page.find("<", self.at)
            if lt < 0:
                reader.text(page[self.at :])
                return
            letter = page[lt + 1 : lt + 2]
            closing = letter == "/"
            first = page[lt + 2 : lt + 3] if closing else letter
            if not (first.isascii() and first.isalpha() or letter in ("!", "?", "/") and letter):
                reader.text(page[self.at : lt + 1])
                self.at = lt + 1
                continue
            if lt > self.at:
                reader.text(page[self.at : lt])
            if page.startswith("<!--", lt):
                self.at = self._past("-->", lt + 4)
            elif page.startswith("<![CDATA[", lt):
                self.at = self._past("]]>", lt)
            elif not (first.isascii() and first.isalpha()):
                self.at = self._past(">", lt)
            else:
                name = _NAME.match(page, lt + 1 + closing)
                tag = name[0].lower()
                self.at = self._past(">", name.end()) if closing else self._end(name.end())
                if closing:
                    reader.end(tag)
                elif tag in _RAW:
                    low = page.lower() if low is None else low
                    close = low.find(f"</{tag}", self.at) if len(low) == len(page) else -1
                    if len(low) != len(page):  # a letter whose lower form is longer
                        m = re.compile(f"</{re.escape(tag)}", re.I).search(page, self.at)
                        close = m.start() if m else -1
                    self.at = len(page) if close < 0 else self._past(">", close)
                else:
                    reader.start(tag, page[name.end() : self.at])


class _Reader:
    def __init__(self) -> None:
        self.lines: list[_Line] = []
        self.open: list[_Element] = []
        self.depth: Counter[str] = Counter()  # open elements by name
        self.articles = 0
        self.line: _Line | None = None

    def part(self) -> None:
        if self.line:
            self.lines.append(self.line)
        self.line = None

    def text(self, raw: str) -> None:
        if not self.line and not raw.strip():
            return
        if not self.line:
            top = self.open[-1] if self.open else None
            self.line = _Line(bare=bool(top and top.bare), article=top.article if top else 0, heading=any(e.tag[0] in "hH" and e.tag[1:].isdigit() for e in self.open[-3:]))
        said = html.unescape(raw)
        self.line.text.append(said)
        if any(e.tag == "a" for e in self.open[-6:]):
            self.line.linked += len(said.strip())

    def close(self, to: int) -> None:
        for e in self.open[to:]:
            self.depth[e.tag] -= 1
        del self.open[to:]

    def start(self, tag: str, attributes: str) -> None:
        if tag == "body":
            self.close(0)
        if tag not in _INLINE:
            self.part()
        if tag in _VOID:
            return
        if tag not in _INLINE and self.open and self.open[self.open[-1].block].tag == "p":
            self.close(self.open[-1].block)  # a block ends the paragraph before it
        _, bare, fixed, article, block = self.open[-1] if self.open else _Element("", False, False, 0, 0)
        known = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
        named = f"{known.get('class', '')} {known.get('id', '')}"
        role = known.get("role", "").lower()
        noisy = bool(_NOISE.search(named)) and tag not in ("body", "html")
        main = tag in ("article", "main") or role in ("main", "article") or known.get("itemprop", "").lower() == "articlebody"
        if main and not noisy:
            if not article:
                self.articles += 1
                article = self.articles
                bare = bare and fixed  # an unclosed advert ends here
        elif tag not in _INLINE or noisy or role in _ROLES:
            bare = bare or noisy or tag in _BARE or role in _ROLES or not article and (tag == "header" or bool(_HEADER.search(named)))
            fixed = fixed or tag in _BARE and tag != "head"
        bare = bare or "hidden" in known or known.get("aria-hidden") == "true" or "display:none" in known.get("style", "").replace(" ", "")
        at = len(self.open)
        self.open.append(_Element(tag, bare, fixed, article, at if tag not in _INLINE or not at else block))
        self.depth[tag] += 1

    def end(self, tag: str) -> None:
        if tag not in _INLINE:
            self.part()
        if not self.depth[tag]:
            return
        i = len(self.open) - 1
        while self.open[i].tag != tag:
            i -= 1
        self.close(i)

    def read(self, page: str) -> list[_Line]:
        _Scanner(page).read(self)
        self.part()
        return self.lines


def _kept(lengths: list[int], surge: int, window: int) -> list[bool]:
    """Which lines lie between a surge and the next dive of the sums over windows."""
    n, total = len(lengths), sum(lengths[:window])
    sums, keep = [], [False] * n
    for i in range(n):
        sums.append(total)
        total += (lengths[i + window] if i + window < n else 0) - lengths[i]
    surge = max(1, min(surge, max(sums, default=0)))
    i = 0
    while i < n:
        if sums[i] >= surge:
            while i < n and not lengths[i]:
                i += 1
            while i < n and sums[i] > 0:
                keep[i] = True
                i += 1
        else:
            i += 1
    return keep


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = _Reader().read(page) if page else []
    said = [(x, t) for x, t in ((x, " ".join("".join(x.text).split())) for x in lines) if t and not x.bare and (x.article or len(t) >= 200 or not _NOTICE.match(t))]

    def free(x: _Line, t: str) -> int:
        return 0 if x.linked * 5 >= len(t) * 3 and x.linked else max(len(t) - x.linked, 0)

    weight: Counter[int] = Counter()
    for x, t in said:
        weight[x.article] += free(x, t)
    marked = {a for a, n in weight.items() if a and n}
    said = [(x, t) for x, t in said if not marked or x.article in marked]
    keep = _kept([len(t) if marked else free(x, t) for x, t in said], surge, window)
    for i in range(len(said) - 1, 0, -1):  # headings right above the text are of the article
        if keep[i] and not keep[i - 1] and said[i - 1][0].heading:
            keep[i - 1] = True
    return " ".join(t for (_, t), k in zip(said, keep, strict=True) if k)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row, in one narrow pass."""
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def one(rows: dict[str, list]) -> dict[str, list]:
        texts = [main_text(h, window, surge) for h in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return rowwise(source, "page_id long, url string, text string, n_chars long", one, 128)
