"""Main text of web pages, by the page nearest in URL.

1. Each page is cut into lines of text: block tags end a line, and every line knows the elements it stands in. Scripts,
   styles, comments and the head give none.
2. Lines inside marked parts that are no article (menus, headers, footers, sidebars, forms, notices, adverts and reader
   comments, by element, role or whole class name) are dropped. An explicit article opens again what only a name
   closed, but not reader comments; parts that hold articles of others only where the page has no article else.
3. Pages with lines outside articles are put in order of URL path within their host, and each is paired with the nearest
   one whose lines differ: mirrors and repeated rows share a place in that order. The lines of both are aligned by longest common
   subsequence, and lines that both have are deleted: what neighbours share is the site's, not the page's. A neighbour that has
   nearly all of a page is taken for a copy of it, and the neighbour on the other side decides; if that is one too, only lines that
   both have are deleted.
4. The page's text is its article where that is at least as long as what differencing leaves outside: an article that is shorter
   is a card or a teaser, and then the lines left are the text, with articles that no name makes a card. Lines of articles are never
   deleted for being shared: neighbours may quote or mirror one another.

Only hashes of the lines outside articles travel to neighbours, and only pages that have such lines travel to meet them:
a bitmap of fixed size tells the others, which are finished where they are read. Every page is cut twice and stored never.
Hosts are cut into chunks by rows, so no host is one task's.

Defined cases: null and empty html gives an empty text; a null or odd URL is a host of its own kind ("") with the URL as
its path; pages without a neighbour are judged by marks alone; rows that repeat a page get the same text; truncated
markup counts as far as it goes. Extra columns play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.components import written
from runlens.llm.repeats import among, bitmap_bits, bitmap_of
from runlens.plans.ordered import HotGroups, previous, with_ordered

#: A host is cut from so many outlines on.
HOT_HOST = HotGroups(min_rows=20_000)
#: A neighbour that has such a share of a page is a copy of it.
COPY = 0.9

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "noframes", "xmp", "svg", "math", "title", "object", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr",
}
_CLUTTER = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "fieldset"}
_CLUTTER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_CLUTTER_WORDS = (
    r"(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|notice|notification|"
    r"alert|popup|modal|overlay|newsletter|subscribe|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|widget|footer|"
    r"header|masthead|comments?|commentlist|replies|reply|respond|disqus|share|sharing|social|related|recommended|toolbar|"
    r"pagination|pager|login|signup|search|skip|copyright)\d*"
)
#: Whole class names: a clutter word, where on the site it stands, and what kind of part it is.
_CLUTTER_NAMES = re.compile(
    rf"(?<!\S)(?:(?:site|main|global|top|bottom|left|right|primary|secondary|google|user|reader)[_-]+)*{_CLUTTER_WORDS}(?:[_-]+(?:{_CLUTTER_WORDS}|\d+|"
    r"posts?|articles?|stories|links?|list|items?|buttons?|box|bar|block|container|wrapper|wrap|area|slot|unit|form|panel|"
    r"section|inner|outer|content|left|right|top|bottom|main|thread|icons?|message|text|to))*(?!\S)",
    re.I,
)
#: Parts of an article whose names end like those of a site's parts.
_OF_ARTICLE = re.compile(r"(?<!\S)(?:article|post|entry|content|story|page|body|text)[_-](?:header|head|side|menu|search)(?!\S)", re.I)
_MAIN = {"article", "main"}
#: Whole class names by which an article element is none.
_NO_ARTICLE = {"comment", "comments", "reply", "ad", "ads", "advert", "related", "sidebar", "promo", "teaser"}
#: Names of parts that hold articles of others: readers' comments never open again, the rest only without another article.
_OF_READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|reply|respond|disqus)(?:$|[\s_-]|\d)", re.I)
_OF_OTHERS = re.compile(r"(?:^|[\s_-])(?:related|recommended|sidebar|widget)(?:$|[\s_-]|\d)", re.I)
_ADVERTS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?)(?:$|[\s_-]|\d)", re.I)
#: Class names of parts that show other pages' articles in short.
_CARD = re.compile(r"class\s*=\s*[\"']?(?:[^\"'>]*\s)?(?:[\w-]*[_-])?(?:teaser|card|promo|preview|excerpt|tile)s?(?=[\s\"'>]|$)", re.I)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ENDS_PARAGRAPH = {"li", "p", "option", "td", "th", "tr", "dt", "dd"}

MAIN, CLUTTER, OPEN = 0, 1, 2


class _Wrapper:
    """An element that is clutter by its name only."""

    def __init__(self, tag: str, names: str):
        self.tag, self.closed = tag, False
        self.advert, self.others = bool(_ADVERTS.search(names)), bool(_OF_OTHERS.search(names))


def _kind(tag: str, attributes: str, above: int) -> tuple[int | None, str | None]:
    """What an element says of the lines in it, and the names by which it says so, if by names only."""
    found = {}
    if "=" in attributes:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if tag in _CLUTTER or role in _CLUTTER_ROLES:
        return CLUTTER, None
    if tag in _MAIN or role in ("main", "article"):
        return (CLUTTER, None) if _NO_ARTICLE & set(names.lower().split()) else (MAIN, None)
    if above == MAIN and tag in _HEADINGS:
        return None, None
    if above == MAIN and tag == "section":
        # Ids of sections are named after what they are about.
        names = found.get("class", "") + (" comments" if _OF_READERS.fullmatch(found.get("id", "")) else "")
    if tag not in ("html", "body") and names.strip():
        matched = " ".join(m[0] for m in _CLUTTER_NAMES.finditer(_OF_ARTICLE.sub("", names)))
        if matched:
            return CLUTTER, None if _OF_READERS.search(matched) else matched
    return None, None


def lines_of(html: str | None) -> list[tuple[int, str]]:
    """The lines of a page as (MAIN, CLUTTER or OPEN, text)."""
    return [(k, t) for k, t, _, _ in placed_lines(html)]


def placed_lines(html: str | None) -> list[tuple[int, str, int, bool]]:
    """The lines of a page as (MAIN, CLUTTER or OPEN, text, number of the article, whether that is a card)."""
    out: list[tuple[int, str, tuple[_Wrapper, ...], int, bool]] = []
    # Tag, kind, the wrappers that only a name makes clutter (None where an article may not open again), the article, card.
    stack: list[tuple[str, int, tuple[_Wrapper, ...] | None, int, bool]] = []
    articles = 0
    opened: dict[str, int] = {}
    pieces: list[str] = []

    def end_line() -> None:
        text = _SPACE.sub(" ", unescape("".join(pieces))).strip()
        if text:
            _, kind, wrappers, article, card = stack[-1] if stack else ("", OPEN, (), 0, False)
            out.append((kind, text, wrappers or (), article, card))
        pieces.clear()

    def ended(element: tuple) -> None:
        if element[1] == CLUTTER and element[2] and element[2][-1].tag == element[0]:
            held = sum(1 for _, k, w, *_ in stack if k == CLUTTER and w and element[2][-1] in w)
            element[2][-1].closed |= not held

    html, at = html or "", 0
    lower = None
    while at < len(html):
        found = _TOKEN.search(html, at)
        if found is None:
            pieces.append(html[at:])
            break
        pieces.append(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag not in _INLINE:
                end_line()
            opened[tag] = opened.get(tag, 0) - 1
            if any(t == tag for t, *_ in stack):
                while stack[-1][0] != tag:
                    stack.pop()
                ended(stack.pop())
        elif tag in _RAW:
            if tag not in _INLINE:
                end_line()
            lower = html.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at)
            close = html.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(html)
        elif tag in _VOID or found[3].endswith("/"):
            if tag not in _INLINE:
                end_line()
        else:
            if tag not in _INLINE:
                end_line()
            if tag in _ENDS_PARAGRAPH:
                while stack and stack[-1][0] == tag:
                    ended(stack.pop())
            opened[tag] = opened.get(tag, 0) + 1
            _, above, wrappers, article, card = stack[-1] if stack else (None, OPEN, (), 0, False)
            kind, names = _kind(tag, found[3], above)
            if kind == CLUTTER:
                wrappers = None if names is None or wrappers is None else (*wrappers, _Wrapper(tag, names))
            elif above == CLUTTER:
                kind = MAIN if kind == MAIN and wrappers is not None else CLUTTER
            if above != MAIN:
                card = card or bool(found[3]) and _CARD.search(found[3]) is not None
                if kind == MAIN:
                    articles += 1
                    article = articles
            stack.append((tag, above if kind is None else kind, wrappers, article, card))
    end_line()
    plain = any(k == MAIN and not any(w.advert or w.others for w in wrappers) for k, _, wrappers, *_ in out)

    def holds(w: _Wrapper) -> bool:
        """Whether a wrapper keeps its articles closed: one that is not closed itself seems to have lost its end."""
        if not w.closed:
            return False
        if w.advert:
            return plain or opened.get(w.tag, 0) <= 0
        return w.others and plain

    return [(CLUTTER if k == MAIN and any(map(holds, wrappers)) else k, t, a, c) for k, t, wrappers, a, c in out]


def _hashes(lines: list[tuple[int, str, int, bool]]) -> list[int]:
    """Hashes of the lines outside articles."""
    return [crc32(t.encode("utf-8", "replace")) for k, t, *_ in lines if k == OPEN]


def text_of(lines: list[tuple[int, str, int, bool]], near: list[list[int]]) -> str:
    """A page's main text, by its lines and the outlines of its neighbours, the nearest first."""
    opened = [t for k, t, *_ in lines if k == OPEN]
    shared, size = [False] * len(opened), sum(map(len, opened))
    if opened:
        own = _hashes(lines)
        both = [shared_lines(own, other) for other in near]
        pages_own = [f for f in both if sum(len(t) for t, s in zip(opened, f, strict=True) if s) <= COPY * size]
        if pages_own:
            shared = pages_own[0]
        elif len(both) > 1:
            shared = [all(x) for x in zip(*both, strict=True)]
    left = iter(shared)
    kept = [(k, t, a, c) for k, t, a, c in lines if k == MAIN or k == OPEN and not next(left)]
    sizes: dict[int, int] = {}
    whole = any(k == MAIN and not c for k, _, _, c in kept)
    for k, t, a, c in kept:
        if k == MAIN and not (whole and c):
            sizes[a] = sizes.get(a, 0) + len(t)
    outside = sum(len(t) for k, t, *_ in kept if k == OPEN)
    if sizes and max(sizes.values()) >= outside:
        return " ".join(t for k, t, *_ in kept if k == MAIN)
    return " ".join(t for k, t, _, c in kept if k == OPEN or not c)


def shared_lines(own: list[int], other: list[int]) -> list[bool]:
    """Which of a page's lines the longest common subsequence with another page's lines holds.

    Equal ends are cut off first. Between them, each place of a line in the other page extends the shortest chain of
    matches that it can (Hunt and Szymanski), so the work follows the number of matches.
    """
    shared = [False] * len(own)
    first, last_own, last_other = 0, len(own), len(other)
    while first < min(last_own, last_other) and own[first] == other[first]:
        shared[first] = True
        first += 1
    while last_own > first and last_other > first and own[last_own - 1] == other[last_other - 1]:
        last_own, last_other = last_own - 1, last_other - 1
        shared[last_own] = True
    places: dict[int, list[int]] = {}
    for j in reversed(range(first, last_other)):
        places.setdefault(other[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(first, last_own):
        for j in places.get(own[i], ()):
            k = bisect_left(ends, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(chain)
            else:
                ends[k], chains[k] = j, chain
    chain = chains[-1] if chains else None
    while chain:
        shared[chain[0]] = True
        chain = chain[1]
    return shared


def _address(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path if parts.hostname else url or ""
    except ValueError:
        return "", url or ""


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of (page_id, url, html)."""
    spark = pages.sparkSession
    kept = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("page"))

    def outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                lines = [_hashes(placed_lines(h)) for h in part["html"]]
                address = [_address(u) for u in part["url"]]
                found = {"page": part["page"], "host": [a[0] for a in address], "path": [a[1] for a in address], "lines": lines}
                yield pd.DataFrame(found)[[bool(x) for x in lines]]

    outlines = kept.select("page", "url", "html").mapInPandas(outline, "page bigint, host string, path string, lines array<bigint>")
    outlines = written(spark, outlines.withColumn("outline", F.xxhash64("host", "lines")), "outlines")
    places = outlines.groupBy("host", "outline").agg(F.min(F.struct("path", "page")).alias("first"))
    once = outlines.groupBy("page", "outline").agg(F.min(F.struct("host", "path", "lines")).alias("o")).select("page", "outline", "o.*")
    placed = places.select("outline", "first.*").join(once.select("page", "outline", "host", "lines"), ["page", "outline"])

    order = ["path", "outline"]
    own = F.struct("outline", "lines").alias("own")
    paired = with_ordered(placed.select("host", *order, own), ["host"], order, {"before": previous("own")}, HOT_HOST)
    paired = written(spark, paired.select("outline", "own", "before"), "pairs")
    after = paired.where("before is not null").select(F.col("before.outline").alias("outline"), F.col("own.lines").alias("after"))
    near = paired.join(after, "outline", "left").select("outline", F.array_compact(F.array("before.lines", "after")).alias("near"))
    # By page: a page has one outline; copies of it share their neighbours.
    near = written(spark, once.select("page", "outline").join(near, "outline").select("page", "near"), "near")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                nears = [[] for _ in range(len(part))] if "near" not in part else [[] if n is None else [list(x) for x in n] for n in part["near"]]
                texts = [text_of(placed_lines(h), n) for h, n in zip(part["html"], nears, strict=True)]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    marks = bitmap_of(near.select("page"), bitmap_bits(near.count()))
    meets, alone = (among(kept, marks, inside, "page") for inside in (True, False))
    kind = f"page_id {kept.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"
    met = meets.join(near, "page", "left").select("page_id", "url", "html", "near")
    return alone.select("page_id", "url", "html").mapInPandas(finish, kind).union(met.mapInPandas(finish, kind))
