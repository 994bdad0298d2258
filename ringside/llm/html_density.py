"""Main text of web pages by composite text density.

A page becomes a tree of elements. Parts that are no article by their element, role or name (menus, footers, adverts,
forms, notices, comments, scripts and so on) are taken out. Names count on block containers only, never on headings,
paragraphs, inline elements and the like. A class outside ``article`` and ``main`` counts if one of its parts is listed; an id,
and any name inside them, only if all its parts are listed or say no more than where a box stands, since such names are
also those of sections ("side-effects"). Every remaining node has a density: its characters per tag, times
the logarithm of its characters and tags over those inside links, in a base that grows with the node's and the body's
share of link text (Sun, Song and Liao, 2011; the base is kept above e, so that a body without links has one too). The
sum of its children's densities is a node's score. The smallest density on the path from the best-scored node up to the
body is the threshold; below the body, every child that reaches it gives its best-scored subtree as content.

Defined results: null, empty or tag-only pages give an empty text. Text outside any element belongs to the body. Broken
markup is read as it comes: unknown end tags are skipped, open elements end with their parent. White space inside a
block becomes one blank, blocks are joined by an empty line. Pages are read one by one, so repeated rows and tables of
any size behave alike; only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small "
    "span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover "
    "munderover mmultiscripts mtable mtr mtd semantics annotation annotation-xml".split())
NO_ARTICLE = frozenset(
    "nav footer aside form script style noscript template iframe object embed applet button select option input textarea "
    "svg canvas audio video map dialog menu head title fieldset datalist annotation annotation-xml".split())
#: What may stand in a head without ending it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements whose class or id can take them out.
CONTAINERS = frozenset("div section ul ol dl table tbody thead tfoot tr td header center".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
NO_ARTICLE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side aside footer foot comment comments disqus respond replies cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended widget toolbar pager pagination masthead skip".split())
#: Parts of names that only say what kind of box stands where.
BOX_NAMES = frozenset(
    "area bar block body bottom box button buttons container content footer form group header icons inner item items left "
    "link links list main outer panel post posts primary right row secondary section site slot stories top unit wrap wrapper "
    "".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z>][^>]*+>|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?")
_PARTS = re.compile(r"[^a-z]+")


def _names_no_article(value: str, whole: bool) -> bool:
    for name in value.split():
        parts = set(_PARTS.split(name)) - {""}
        if not NO_ARTICLE_NAMES.isdisjoint(parts) and (not whole or parts <= NO_ARTICLE_NAMES | BOX_NAMES):
            return True
    return False


def _foreign(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in NO_ARTICLE or tag == "header" and not inside_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    if "hidden" in found or found.get("role", "").strip() in NO_ARTICLE_ROLES:
        return True
    if tag not in CONTAINERS and "-" not in tag:
        return False
    return _names_no_article(found.get("class", ""), inside_article) or _names_no_article(found.get("id", ""), True)


def main_text(page: str | None) -> str:
    """Blocks of the article, joined by an empty line."""
    page = page or ""
    tags, parents, foreign, article = ["body"], [-1], [False], [False]
    chars, count, link_chars, link_tags, in_link = [0], [0], [0], [0], [False]
    pieces: list[tuple[int, str]] = []  # (node, text); node -1 ends a block
    stack, at, raw = [0], 0, None

    def text(end: int) -> None:
        if tags[stack[-1]] == "head" and page[at:end].strip():
            close(len(stack) - 1)
        node = stack[-1]
        if end > at and not foreign[node]:
            value = entities.unescape(page[at:end])
            pieces.append((node, value))
            visible = len(" ".join(value.split()))
            chars[node] += visible
            if in_link[node]:
                link_chars[node] += visible

    def close(upto: int) -> None:
        while len(stack) > upto:
            if tags[stack.pop()] not in INLINE:
                pieces.append((-1, ""))

    while True:
        if raw:
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            raw = None
        m = _TAG.search(page, at)
        text(m.start() if m else len(page))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == tag:
                    close(k)
                    break
            else:
                if tag not in INLINE:
                    pieces.append((-1, ""))
            continue
        if tag == "body":
            for k in range(1, len(stack)):
                if tags[stack[k]] == "head":
                    close(k)
                    break
        elif tags[stack[-1]] == "head" and tag not in IN_HEAD and tag != "html":
            close(len(stack) - 1)
        if tag in ("html", "body") or tag == "head" and len(tags) > 1:
            continue
        if tag == "br":
            pieces.append((stack[-1], " "))
            continue
        if tag in ENDS_PARAGRAPH or tag in CLOSES:
            ends = CLOSES.get(tag, "p").split()
            barrier = ("table", "ul", "ol", "dl", "select") if tag in CLOSES else ("td", "th", "button")
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in ends:
                    close(k)
                    if tag not in ("td", "tr", "th"):
                        break
                elif tags[stack[k]] in barrier:
                    break
        node, up = len(tags), stack[-1]
        tags.append(tag)
        parents.append(up)
        article.append(article[up] or tag in ("article", "main"))
        foreign.append(foreign[up] or _foreign(tag, m[3], article[up]))
        in_link.append(in_link[up] or tag == "a")
        chars.append(0)
        count.append(0)
        link_chars.append(0)
        link_tags.append(0)
        if tag not in INLINE:
            pieces.append((-1, ""))
        if tag in VOID:
            continue
        stack.append(node)
        if tag in RAW:
            raw = tag

    # totals of subtrees: children come after their parents
    for node in range(len(tags) - 1, 0, -1):
        if foreign[node]:
            continue
        up = parents[node]
        chars[up] += chars[node]
        link_chars[up] += link_chars[node]
        count[up] += count[node] + 1
        link_tags[up] += link_tags[node] + (tags[node] == "a")
    if not chars[0]:
        return ""
    share = link_chars[0] / chars[0]
    density, total = [0.0] * len(tags), [0.0] * len(tags)
    for node in range(len(tags) - 1, -1, -1):
        c = chars[node]
        if foreign[node] or not c:
            continue
        t, lc, lt = max(1, count[node]), link_chars[node], max(1, link_tags[node])
        base = math.log(math.e + c * lc / max(1, c - lc) + share * c)
        density[node] = c / t * math.log(math.e + c * t / (max(1, lc) * lt)) / (1 + math.log(base))
        if lc == c:
            density[node] = 0.0
        if node:
            total[parents[node]] += density[node]
    best = max(range(len(tags)), key=lambda n: (total[n], -n))
    chosen = [False] * len(tags)
    if total[best] <= 0:
        chosen[0] = True
    else:
        node, threshold = best, density[best]
        while node > 0:
            node = parents[node]
            threshold = min(threshold, density[node])
        # best-scored node of every subtree; the first (outermost) on ties
        peak = list(range(len(tags)))
        for node in range(len(tags) - 1, 0, -1):
            up = parents[node]
            if total[peak[node]] > total[peak[up]]:
                peak[up] = peak[node]
        open_ = [True] + [False] * (len(tags) - 1)
        chosen[best] = True
        for node in range(1, len(tags)):
            if open_[parents[node]] and chars[node] and density[node] >= threshold:
                open_[node] = True
                chosen[peak[node]] = True
        # text of the body itself stands beside its children
        chosen[0] = chosen[0] or best == 0
    for node in range(1, len(tags)):
        chosen[node] = (chosen[node] or chosen[parents[node]]) and not foreign[node]
    blocks, current = [], []
    for node, value in [*pieces, (-1, "")]:
        if node >= 0:
            if chosen[node]:
                current.append(value)
        elif current:
            block = " ".join("".join(current).split())
            if block:
                blocks.append(block)
            current = []
    return "\n\n".join(blocks)


def _extract(batches):
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
