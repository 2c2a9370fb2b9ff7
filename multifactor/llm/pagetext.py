"""The main text of web pages by scoring the tree of their blocks."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from multifactor.llm.common import quoted, with_results

# Tags by what they do; all others are inline and leave the block they stand in whole.
_PARAGRAPHS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption summary address".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCKS = _PARAGRAPHS | frozenset(
    "html body div section article main ul ol dl table thead tbody tfoot tr figure details fieldset center hr "
    "head nav header footer aside form menu dialog noscript template button select iframe object svg canvas audio video".split()
)
_VOID = frozenset("hr iframe".split())
#: Their content is no markup: read on at their end tag.
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Never part of an article.
_OUTSIDE = frozenset("head nav footer aside form menu dialog noscript template button select iframe object svg canvas audio video".split())
#: A new one ends an open one of these names, unless the list or table that holds it comes first.
_ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, set()),
}
#: Words in class, id and role of what is no article, and of what may be one.
_FOREIGN = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars rail widget widgets menu menus nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager masthead topbar footer colophon copyright legal comment comments commentlist respond reply replies discussion "
    "disqus feedback share sharing social related recommended recommendations login search toolbar skip contentinfo complementary dialog".split()
)
_HEADER = frozenset({"header"})
_WELCOME = frozenset("article articlebody content post entry hentry story main text body page blog".split())
#: Before such a word, a name only says what is there or is not.
_NEGATED = frozenset("has with no without is not".split())
_TAG = re.compile(r"<(?:!--|(/?)([A-Za-z][^\s/>]*+)|[!?/])")
_TAG_END = re.compile(r"(?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?(?![^\s/>])", re.I)
_NAMES, _PARTS = re.compile(r"\S+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
#: Ancestors that a paragraph's points reach, each a share smaller.
LEVELS = 5


def _words(names: str) -> list[list[str]]:
    """The words of each of several names: ``postBody has-sidebar`` gives post and body, has and sidebar."""
    return [[w.lower() for w in _PARTS.findall(n)] for n in _NAMES.findall(names)]


class _Page:
    """The blocks of a page and the tree of the elements that hold them; parsing is linear in the page's length."""

    def __init__(self, html: str):
        self.tag, self.parent, self.names, self.outside = ["#page"], [-1], [""], [False]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self._open, self._counts, self._text, self._links, self._link = [0], {}, [], 0, -1
        self._parse(html)
        self._flush()

    def _parse(self, html: str) -> None:
        at = 0
        while True:
            tag = _TAG.search(html, at)
            self._write(html[at : tag.start() if tag else len(html)])
            if not tag:
                return
            if html.startswith("<!--", tag.start()):
                end = tag.end() if html.startswith((">", "->"), tag.end()) else html.find("-->", tag.end())
                if end < 0:
                    return
                at = html.find(">", end) + 1
                continue
            end = _TAG_END.match(html, tag.end())
            if not end:  # a tag that the page's end cuts
                return
            at = end.end()
            name = (tag[2] or "").lower()
            if not name:
                continue
            if tag[1]:
                self._end(name)
                continue
            self._start(name, html[tag.end() : at - 1])
            if name in _RAW:
                close = _RAW_END[name].search(html, at)
                if not close:
                    return
                at = close.start()

    def _write(self, raw: str) -> None:
        if raw and not self.outside[self._open[-1]]:
            text = unescape(raw)
            self._text.append(text)
            if self._link >= 0:
                self._links += len(text)

    def _flush(self) -> None:
        """End the block that has been written so far."""
        text = " ".join("".join(self._text).split())
        if text:
            self.blocks.append((self._open[-1], text, min(self._links, len(text))))
        self._text, self._links = [], 0

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._write(" ")
        if name == "a":
            self._link = len(self._open)
        if name not in _BLOCKS:
            return
        self._flush()
        top = self.tag[self._open[-1]]
        if top == "p" or (top in _HEADINGS and name in _HEADINGS):
            self._pop(len(self._open) - 1)
        if name in _ENDED_BY:
            ended, held = _ENDED_BY[name]
            for i in range(len(self._open) - 1, 0, -1):
                if self.tag[self._open[i]] in held:
                    break
                if self.tag[self._open[i]] in ended:
                    self._pop(i)
                    break
                if len(self._open) - i > 64:
                    break
        found = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        up = self._open[-1]
        self.names.append(" ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop")))
        self.tag.append(name)
        self.parent.append(up)
        self.outside.append(self._is_outside(name, up, found))
        if name not in _VOID:
            self._open.append(len(self.tag) - 1)
            self._counts[name] = self._counts.get(name, 0) + 1

    def _is_outside(self, name: str, up: int, found: dict[str, str]) -> bool:
        if self.outside[up]:
            return not (name in ("article", "main") and self.tag[up] == "form" and not self.outside[self.parent[up]])
        if name in _OUTSIDE or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
            return True
        foreign = _FOREIGN
        if not (self._counts.get("article") or self._counts.get("main")):  # headers of pages, not of articles
            if name == "header":
                return True
            foreign = _FOREIGN | _HEADER
        if name in ("html", "body", "main") or not found:
            return False
        return any(foreign & set(words) and not _NEGATED & set(words) for words in _words(self.names[-1]))

    def _end(self, name: str) -> None:
        if name == "a":
            self._link = -1
        if name not in _BLOCKS:
            return
        self._flush()
        if self._counts.get(name):
            i = len(self._open) - 1
            while self.tag[self._open[i]] != name:
                i -= 1
            self._pop(i)

    def _pop(self, i: int) -> None:
        for node in self._open[i:]:
            self._counts[self.tag[node]] -= 1
        del self._open[i:]
        if self._link > len(self._open):
            self._link = -1


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, a line each; empty if there is none.

    Each block passes points for its length and commas to its paragraph's ancestors, ever smaller shares of them; an
    element's points count by the share of its text outside links, with a start by its tag and names. The best element is
    kept, or the ``article`` around it, with those of its siblings that have a fifth of its points, that are prose, or that
    are headings. Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are no
    part, by their tags, roles and names.
    """
    page = _Page(html or "")
    n = len(page.tag)
    points, chars, links = [0.0] * n, [0] * n, [0] * n
    for node, text, linked in page.blocks:
        chars[node] += len(text)
        links[node] += linked
        at = page.parent[node] if page.tag[node] in _PARAGRAPHS else node
        gained = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        for level in range(LEVELS):
            if at < 0:
                break
            points[at] += gained / (1, 2, 6, 9, 12)[level]
            at = page.parent[at]
    for node in range(n - 1, 0, -1):  # children come after their parents
        chars[page.parent[node]] += chars[node]
        links[page.parent[node]] += links[node]
    if not chars[0]:
        return ""
    own = [p * (1 - links[i] / chars[i]) if chars[i] else -1.0 for i, p in enumerate(points)]
    best = max((i for i in range(n) if own[i] > 0 and page.tag[i] not in _PARAGRAPHS), key=lambda i: (own[i] + _start_points(page, i), -i), default=None)
    if best is None:
        return ""
    around, at = [], best
    while at >= 0:
        if page.tag[at] == "article":
            around = [at]
        at = page.parent[at]
    best = around[0] if around else best
    kept = {best} | {i for i in range(1, n) if page.parent[i] == page.parent[best] and _belongs(page, i, best, own, chars, links)}
    inside = [False] * n
    for i in range(n):
        inside[i] = i in kept or (i > 0 and inside[page.parent[i]])
    return "\n".join(text for node, text, _ in page.blocks if inside[node])


def _start_points(page: _Page, i: int) -> float:
    tag = page.tag[i]
    start = 50.0 if tag == "article" else 25.0 if tag == "main" else 5.0 if tag in ("div", "section") else -3.0 if tag in ("ul", "ol", "dl", "table") else 0.0
    return start + 25.0 * (tag not in ("html", "body", "#page") and any(_WELCOME & set(words) and not _NEGATED & set(words) for words in _words(page.names[i])))


def _belongs(page: _Page, i: int, best: int, own: list[float], chars: list[int], links: list[int]) -> bool:
    """True if a sibling of the best element continues it."""
    if not chars[i]:
        return False
    if page.tag[best] == "article":
        return page.tag[i] == "article" and own[i] >= max(10.0, own[best] / 5)
    if page.tag[i] in _PARAGRAPHS:
        return links[i] < chars[i] / 4 and (page.tag[i] in _HEADINGS or chars[i] > 80)
    return own[i] >= max(10.0, own[best] / 5)


@F.pandas_udf(T.StringType())
def _main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def page_text(html: Column) -> Column:
    """The main text of each page (null: empty)."""
    return _main_texts(F.coalesce(html.cast("string"), F.lit("")))


def extracted(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its code points; columns of these names get underscores.

    Each page is read by itself, so rows move nowhere. A null, empty or blank page and one without an article have the
    empty text; what a page's cut end leaves open ends there; repeated rows each get theirs; an empty table gives none.
    """
    found = with_results(pages, text=page_text(F.col(quoted(html))))
    return with_results(found, n_chars=F.char_length("text").cast("long"))
