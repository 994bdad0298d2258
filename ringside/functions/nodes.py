"""Pages as node tables: one pass over the tags of a page, then selections as columns.

``scan`` walks a page once with the stack of its open elements and gives, in page order, every element with its parent, its
last descendant, its line, some of its attributes, its nearest ancestors of the asked tags, and its stretch of the page's
texts. Descendants of an element are the nodes after it up to its last one, its text is a slice of the texts: selections
are filters over arrays in the JVM, however deep or irregular the page is. A page stays one row; nothing is copied per node.

Defined results: a null page has no nodes. End tags without an open element are left out, elements left open end with their
parent; table rows, cells, list items, options and paragraphs end where the next one starts. Texts of scripts and styles are
texts of their element; comments are left out. An attribute given twice has its first value. Tags and attribute names are in
lower case.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

from ringside.functions.html import LINE_BREAK
from ringside.functions.text import strip

#: Comments and declarations; tags, whose quoted values may hold a ``>``; tags with a quote that never ends.
_TOKEN = re.compile(
    r"""<!--.*?-->|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|"""
    r"""<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")

# Fixed values of HTML: elements without content, with raw content, and the blocks that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style"))
BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
    "table ul".split())
#: What a start tag ends, and the elements beyond which it ends nothing.
_TABLE = frozenset(("table",))
_CELLS = frozenset(("td", "th"))
_GROUPS = frozenset(("tbody", "thead", "tfoot"))
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (_CELLS | {"tr"}, _TABLE),
    "td": (_CELLS, _TABLE | {"tr"}),
    "th": (_CELLS, _TABLE | {"tr"}),
    **{g: (_CELLS | _GROUPS | {"tr"}, _TABLE) for g in _GROUPS},
    **{b: (frozenset(("p",)), _CELLS | {"table", "button"}) for b in BLOCKS},
}


#: Characters and nodes of scanned pages that a worker holds before it hands them back: they bound its memory, no page.
PIECE_CHARS, PIECE_NODES = 2 << 20, 20_000


class Scanner:
    """The nodes and texts of one page."""

    def __init__(self, attributes: frozenset[str], holders: tuple[str, ...]):
        self.attributes, self.holders = attributes, holders
        self.nodes: list[dict] = []
        self.texts: list[str] = []
        self.stack: list[int] = []
        #: open elements per tag, the latest last
        self.open: dict[str, list[int]] = {}

    def read(self, page: str) -> None:
        at, line, counted = 0, 1, 0
        # behind the last ">" there is no tag
        limit = page.rfind(">") + 1
        while True:
            token = _TOKEN.search(page, at, limit)
            end = token.start() if token else len(page)
            if end > at:
                self.texts.append(html_lib.unescape(page[at:end]))
            if not token:
                break
            at = token.end()
            closing, name, inner = token.groups()[:3] if token[2] else token.groups()[3:]
            if name is None:
                continue
            tag = name.lower()
            if closing:
                self._end(tag)
                continue
            line, counted = line + page.count("\n", counted, token.start()), token.start()
            self._start(tag, inner, line)
            if tag in RAW:
                close = re.compile(rf"</{tag}", re.I).search(page, at)
                stop = close.start() if close else len(page)
                if stop > at:
                    self.texts.append(page[at:stop])
                at = stop
        while self.stack:
            self._pop()

    def _start(self, tag: str, inner: str, line: int) -> None:
        ended, beyond = ENDS.get(tag, (None, None))
        while ended and any(self.open.get(t) for t in ended):
            # the latest element that ends, unless a barrier is open inside it
            last = max(self.open[t][-1] for t in ended if self.open.get(t))
            if any(self.open.get(t) and self.open[t][-1] > last for t in beyond):
                break
            self._close(last)
        kept = {}
        for name, *values in _ATTRIBUTE.findall(inner):
            name = name.lower()
            if name in self.attributes and name not in kept:
                kept[name] = html_lib.unescape("".join(values))
        at = len(self.nodes)
        self.nodes.append({
            "at": at, "tag": tag, "up": self.stack[-1] if self.stack else None, "last": at, "line": line,
            "attrs": list(kept.items()), "within": [(h, self.open[h][-1]) for h in self.holders if self.open.get(h)],
            "text": len(self.texts), "text_end": len(self.texts)})
        if tag not in VOID and not inner.rstrip().endswith("/"):
            self.stack.append(at)
            self.open.setdefault(tag, []).append(at)

    def _end(self, tag: str) -> None:
        if self.open.get(tag):
            last = self.open[tag][-1]
            # a cell's markup cannot end what is open around its table
            if tag == "table" or not any(self.open.get(t) and self.open[t][-1] > last for t in _TABLE):
                self._close(last)

    def _close(self, at: int) -> None:
        while self.stack and self.stack[-1] >= at:
            self._pop()

    def _pop(self) -> None:
        node = self.nodes[self.stack.pop()]
        self.open[node["tag"]].pop()
        node["last"], node["text_end"] = len(self.nodes) - 1, len(self.texts)


_NODE = pa.struct([
    ("at", pa.int32()), ("tag", pa.string()), ("up", pa.int32()), ("last", pa.int32()), ("line", pa.int32()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("within", pa.map_(pa.string(), pa.int32())), ("text", pa.int32()),
    ("text_end", pa.int32())])
_PAGE = pa.struct([("nodes", pa.list_(_NODE)), ("texts", pa.list_(pa.string()))])
PAGE = ("struct<nodes:array<struct<at:int,tag:string,up:int,last:int,line:int,attrs:map<string,string>,"
        "within:map<string,int>,text:int,text_end:int>>,texts:array<string>>")


def scan(html: Column, attributes: tuple[str, ...] = ("class", "href"), holders: tuple[str, ...] = ()) -> Column:
    """``nodes`` and ``texts`` of a page; only the named attributes and nearest ancestors are kept."""
    named = frozenset(attributes)

    @F.arrow_udf(PAGE)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield from pieces(pages, named, holders)

    return scanned(html)


def pieces(pages: pa.Array, attributes: frozenset[str], holders: tuple[str, ...]) -> Iterator[pa.Array]:
    """The scanned pages of a batch in order, a bounded piece at a time."""
    out, chars, nodes = [], 0, 0
    for page in pages:
        scanner, body = Scanner(attributes, holders), page.as_py() or ""
        scanner.read(body)
        out.append({"nodes": scanner.nodes, "texts": scanner.texts})
        chars, nodes = chars + len(body), nodes + len(scanner.nodes)
        if chars >= PIECE_CHARS or nodes >= PIECE_NODES:
            yield pa.array(out, _PAGE)
            out, chars, nodes = [], 0, 0
    if out:
        yield pa.array(out, _PAGE)


Test = Callable[[Column], Column]


def has_class(part: str) -> Test:
    """The class attribute holds ``part`` anywhere."""
    return lambda node: F.coalesce(node["attrs"]["class"].contains(part), F.lit(False))


def is_tag(tag: str) -> Test:
    return lambda node: node["tag"] == tag


def link_to(part: str) -> Test:
    return lambda node: (node["tag"] == "a") & F.coalesce(node["attrs"]["href"].contains(part), F.lit(False))


def both(*tests: Test) -> Test:
    def all_of(node: Column) -> Column:
        out = tests[0](node)
        for test in tests[1:]:
            out = out & test(node)
        return out

    return all_of


def select(page: Column, test: Test) -> Column:
    """Nodes of the whole page that pass, in page order."""
    return F.filter(page["nodes"], test)


def inside(page: Column, node: Column, test: Test) -> Column:
    """Descendants of ``node`` that pass, in page order."""
    return F.filter(F.slice(page["nodes"], node["at"] + 2, node["last"] - node["at"]), test)


def children(page: Column, node: Column, test: Test) -> Column:
    return inside(page, node, lambda n: (n["up"] == node["at"]) & test(n))


def first(nodes: Column) -> Column:
    return F.try_element_at(nodes, F.lit(1))


def holding(page: Column, test: Test, holder: str) -> Column:
    """Nearest ``holder`` elements around the nodes that pass, each once, in page order."""
    at = F.transform(select(page, test), lambda n: n["within"][holder])
    found = F.array_sort(F.array_distinct(F.filter(at, lambda i: i.isNotNull())))
    return F.transform(found, lambda i: page["nodes"][i])


def texts(page: Column, node: Column) -> Column:
    """The texts inside a node, piece by piece."""
    return F.slice(page["texts"], node["text"] + 1, node["text_end"] - node["text"])


def text(page: Column, node: Column) -> Column:
    return F.array_join(texts(page, node), "")


def in_one_line(value: Column) -> Column:
    """Stripped lines that are not blank, joined by a blank."""
    return F.array_join(F.filter(F.transform(F.split(value, LINE_BREAK), strip), lambda x: x != ""), " ")
