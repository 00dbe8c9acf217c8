"""HTML extraction by the maximum-scoring subsequence of a page.

A page becomes a sequence of words and tags. Words score by where they stand (the nearest element
around them, and whether that is inside a link), tags by their name; the weights are log odds of
lying inside the main text, counted on labelled pages. Words of running text score positive and
tags negative, and one linear scan finds the contiguous region with the greatest sum. Labelled
pages are those whose markup names exactly one main element (``article``, ``main`` or
``itemprop="articleBody"``); about ``SAMPLE`` of them are counted, chosen by a hash of id, url
and text. Weights can also be given, and then no page is counted.

Where more than half of the region's words lie inside one such main element, the region becomes
that element, so that a first heading or a last short line is neither lost nor joined by its
surroundings. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are told by their element, role, class or id; they are never text, wherever they
stand. All other text of the region is kept.

White space inside a block becomes one space, character references are decoded, blocks are joined
by one space, and inline elements neither split nor join words.

Edge cases: a null or empty page gives an empty text; a page without tags is its own text; a tag
or comment that never closes ends with the page, and so does an element; a ``<`` that begins no
tag is text; pages of any length are scanned in one pass, and a worker holds one page's tokens;
repeated rows each give a row; null ids and urls are kept; an empty table gives an empty result,
and other columns are not carried. Of regions with equal sums the first is taken.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import prepare, table

#: About how many labelled pages are counted for the weights.
SAMPLE = 2000
#: Weights where labelled pages have not shown an element: a word, a word in a link, a tag, an inline tag.
WORD, LINKED, TAG, INLINE_TAG = 1.0, -1.0, -3.25, -0.5
#: Log odds are counted with this many words on either side added, and end at this size.
SMOOTH, MOST = 2.0, 6.0
#: A tag never scores above this.
TAG_MOST = -0.25

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that are never main text.
FURNITURE = frozenset("head nav header footer aside form menu dialog button select option input textarea script style noscript template iframe svg object audio video canvas map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
#: Words of a class or id that mark furniture.
MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar banner footer colophon copyright sidebar rail aside widget widgets "
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login form comment comments commentlist respond disqus reply replies share sharing social related recommended pagination pager".split()
)
#: A class that says what its element goes with or without, as in has-sidebar, marks no furniture.
ABSENT = frozenset("has with no without".split())
#: Elements whose start ends an open ``p``, and elements that end an open one of their own kind.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl select article main section div body html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_KNOWN = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption div section article main body span".split())
_TAGS = _KNOWN | INLINE | frozenset("ul ol dl table tr tbody thead figure br hr img".split())


@dataclass
class Page:
    """Pieces of a page's text in order, with what the scan needs to know of each."""

    texts: list[str] = field(default_factory=list)
    words: list[int] = field(default_factory=list)  # of each piece
    where: list[str] = field(default_factory=list)  # nearest element, "/a" after it inside a link
    before: list[tuple[str, ...]] = field(default_factory=list)  # tags since the piece before
    breaks: list[bool] = field(default_factory=list)  # whether a block begins here
    mains: list[int] = field(default_factory=list)  # which main element holds it (-1: none)
    held: list[bool] = field(default_factory=list)  # whether furniture holds it


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def is_furniture(name: str, given: dict[str, str]) -> bool:
    if name in FURNITURE or "hidden" in given or given.get("role", "").lower() in ROLES:
        return True
    if name in ("html", "body", "article", "main") or not ("class" in given or "id" in given):
        return False
    for named in f"{given.get('class', '')} {given.get('id', '')}".split():
        parts = {part.lower() for part in _PART.findall(named)}
        if parts & MARKS and not parts & ABSENT:
            return True
    return False


def is_main(name: str, given: dict[str, str]) -> bool:
    return name in ("article", "main") or given.get("itemprop", "").lower() == "articlebody"


def parsed(page: str) -> Page:
    """One pass over the page: tags keep a stack of open elements, text between them makes pieces."""
    out, stack = Page(), []  # of (name, furniture, main, links)
    tags: list[str] = []
    broken, mains, at, size = True, 0, 0, len(page)
    furniture, main, links = 0, -1, 0

    def text(raw: str) -> None:
        nonlocal tags, broken
        if not raw:
            return
        said = html.unescape(raw) if "&" in raw else raw
        name = next((n for n, *_ in reversed(stack) if n not in INLINE), "body")
        out.texts.append(said)
        out.words.append(len(said.split()))
        out.where.append((name if name in _KNOWN else "other") + ("/a" if links else ""))
        out.before.append(tuple(tags))
        out.breaks.append(broken)
        out.mains.append(main)
        out.held.append(furniture > 0)
        tags, broken = [], False

    def pop() -> str:
        nonlocal furniture, main, links, broken
        name, was_furniture, outer, was_link = stack.pop()
        furniture, main, links = furniture - was_furniture, outer, links - was_link
        broken = broken or name not in INLINE
        return name

    def close(names: set[str] | frozenset[str]) -> None:
        """End the innermost open element of these, unless a wider one lies between."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in SCOPES:
                return

    while at < size:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        m = _TOKEN.match(page, start)
        m = m or _LOOSE.match(page, start)  # a quotation mark that never closes
        if not m:
            end = page.find("<", start + 1)
            end = size if end < 0 else end
            text(page[at:end])
            at = end
            continue
        text(page[at:start])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        tags.append((m[1] or "") + (name if name in _TAGS else "other"))
        if m[1]:
            if any(n == name for n, *_ in stack):
                while pop() != name:
                    pass
            elif name not in INLINE:
                broken = True
            continue
        given = attributes(m[3])
        if name in ENDS_P:
            close({"p"})
        if name in SELF_ENDING:
            close(SELF_ENDING[name])
        if name == "body":
            while stack and stack[-1][0] != "html":
                pop()
        if name not in INLINE:
            broken = True
        if name in VOID or m[3].rstrip().endswith("/") and name in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else size
            if end:
                at = page.find(">", at) + 1 or size
                tags.append("/other")
            continue
        is_link, is_main_one = int(name == "a"), is_main(name, given)
        stack.append((name, int(is_furniture(name, given)), main, is_link))
        furniture, links = furniture + stack[-1][1], links + is_link
        if is_main_one and not furniture:
            main, mains = mains, mains + 1
    return out


def label(page: Page) -> int | None:
    """The one main element with text, or None."""
    named = {m for m, w, f in zip(page.mains, page.words, page.held) if m >= 0 and w and not f}
    return named.pop() if len(named) == 1 else None


def counts(pages: Iterator[str]) -> Counter:
    """Of labelled pages: how many words of each kind and tags of each name lie inside and outside."""
    found: Counter = Counter()
    for raw in pages:
        page = parsed(raw)
        main = label(page)
        if main is None:
            continue
        inside = False
        for words, where, tags, of, held in zip(page.words, page.where, page.before, page.mains, page.held):
            for tag in tags:
                found[f"<{tag}", inside and of == main] += 1
            inside = of == main and not held
            if words:
                found[("held" if held else where), inside] += words
    return found


def weights(found: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of lying inside; a tag's weight is never positive."""
    all_in = sum(n for (k, i), n in found.items() if i and k[0] != "<")
    all_out = sum(n for (k, i), n in found.items() if not i and k[0] != "<")
    out = {}
    for kind in {k for k, _ in found}:
        odds = math.log((found.get((kind, True), 0) + SMOOTH) / (found.get((kind, False), 0) + SMOOTH))
        out[kind] = max(-MOST, min(MOST, odds)) if kind[0] != "<" else max(-MOST, min(TAG_MOST, odds + TAG))
    return out if all_in and all_out else {}


def scored(page: Page, known: dict[str, float]) -> list[tuple[float, float]]:
    """(sum of the tags before, sum of the words) of each piece."""
    out = []
    for words, where, tags, held in zip(page.words, page.where, page.before, page.held):
        if held:
            weight = min(known.get("held", LINKED), LINKED)
        else:
            weight = known.get(where, LINKED if where.endswith("/a") else WORD)
        out.append((sum(known.get(f"<{t}", INLINE_TAG if t.lstrip("/") in INLINE else TAG) for t in tags), weight * words))
    return out


def best_region(scores: list[tuple[float, float]]) -> tuple[int, int]:
    """[first, last) of the pieces whose tags and words between have the greatest sum; empty where no word scores above 0."""
    best, sum_here, start, found = 0.0, 0.0, 0, (0, 0)
    for k, (tags, words) in enumerate(scores):
        sum_here += tags
        if sum_here <= 0:
            sum_here, start = 0.0, k
        sum_here += words
        if sum_here > best:
            best, found = sum_here, (start, k + 1)
    return found


def main_text(raw: str | None, known: dict[str, float], snap: bool = True) -> str:
    """The page's main text. Without ``snap`` the region alone decides, whatever the markup says."""
    page = parsed(raw or "")
    first, last = best_region(scored(page, known))
    chosen = range(first, last)
    if snap:
        inside = Counter()
        for k in chosen:
            inside[page.mains[k]] += 0 if page.held[k] else page.words[k]
        main, most = max(inside.items(), key=lambda x: x[1], default=(-1, 0))
        if main >= 0 and 2 * most > sum(inside.values()):
            chosen = [k for k in range(len(page.texts)) if page.mains[k] == main]
    parts, broken, before = [], False, None
    for k in chosen:
        broken = broken or page.breaks[k] or before != k - 1
        before = k
        if page.held[k]:
            broken = True
            continue
        if broken:
            parts.append(" ")
        parts.append(page.texts[k])
        broken = False
    return " ".join("".join(parts).split())


def learn(pages: DataFrame, sample: int = SAMPLE, id: str = "page_id", url: str = "url", text: str = "html") -> dict[str, float]:
    """Weights from about ``sample`` of the pages: counts of at most some hundred kinds come to the driver."""
    prepare(pages.sparkSession)
    share = min(1.0, sample / max(1, pages.count()))
    drawn = F.pmod(F.xxhash64(F.col(id).cast("string"), F.col(url).cast("string"), F.octet_length(text)), F.lit(1 << 30)) < int(share * (1 << 30))

    def work(batches):
        for batch in batches:
            found = counts(x for x in batch.column(0).to_pylist() if x)
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([found[k] for k in keys], pa.int64())], names=["kind", "inside", "n"]
            )

    counted = pages.where(drawn).select(F.col(text).cast("string").alias("_html")).mapInArrow(work, "kind string, inside boolean, n long")
    return weights({(r.kind, r.inside): r.n for r in counted.groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()})


def extract(pages: DataFrame, known: dict[str, float] | None = None, snap: bool = True, id: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """Id, url, ``text`` and ``n_chars`` (code points) of every page."""
    prepare(pages.sparkSession)
    known = learn(pages, id=id, url=url, text=text) if known is None else known

    def work(batches):
        for batch in batches:
            texts = [main_text(x, known, snap) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[id, url, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id, url))
    return pages.select(id, url, F.col(text).cast("string").alias("_html")).mapInArrow(work, f"{kinds}, text string, n_chars long")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: The pages of this table state their main text as one ``article`` of paragraphs, headings, breaks and bold text. Tests hold the scan itself, without that statement, against brute force.
ORACLE = {
    "op11_main_text": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', chr(160)) AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '[\s\x0B\x{A0}]+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d""",
}
