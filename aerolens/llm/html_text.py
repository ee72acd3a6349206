"""Main text of web pages by composite text density.

A tolerant scan builds the element tree. For every element of the whole tree, characters per tag are adjusted by its share
of links; of the elements that hold blocks, the one whose children's densities have the largest sum holds the article, whatever its tag or name.
The least density on its path to the body is the threshold at or below which lists inside it are menus and go. Inside the chosen
element, and nowhere else, what reads like the article but is none goes by what it says it is: adverts, notices, forms, reader comments.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup; nothing of it is shown as the page's text.
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCK - frozenset("br body head html td th tr tbody thead tfoot caption option optgroup legend li dd dt".split()) | frozenset(["li", "dd", "dt"])
#: A start tag of the key ends an open element of the value, up to one of the limits.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Inside the chosen element these go, if their tag, role or a word of their class or id says so. Whatever lies outside it needs no list.
DROP_TAGS = frozenset("nav footer aside form button select menu head dialog canvas object audio video svg math applet frameset datalist fieldset".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog".split())
#: Prose that densities can't tell from an article's: adverts, notices, invitations and comments.
DROP_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent notice notices newsletter sidebar share comment comments disqus replies".split())
NEVER_DROP = frozenset(["html", "body", "article", "main"])
#: How sure a drop is: by tag or role, or by a word of its class or id only.
SURE, NAMED = 1, 2
LISTS = frozenset(["ul", "ol", "dl"])


class Node:
    __slots__ = ("tag", "parent", "items", "drop", "chars", "tags", "link_chars", "link_tags", "density", "total", "kids")

    def __init__(self, tag: str, parent: Node | None, drop: int = 0):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.items: list = []
        self.kids: list[Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _dropped(tag: str, attrs: str, in_article: bool) -> int:
    if tag in NEVER_DROP:
        return 0
    if tag in DROP_TAGS or tag == "header" and not in_article:
        return SURE
    drop = 0
    if attrs:
        for m in _ATTR.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "role":
                if value.strip().lower() in DROP_ROLES:
                    return SURE
            elif any(x.lower() in DROP_NAMES for x in _NAME.findall(value)):
                drop = NAMED
    return drop


class _Open:
    """The open elements, and for each tag how deep its open elements are."""

    def __init__(self, root: Node):
        self.stack, self.depths = [root], defaultdict(list)

    def last(self, tags) -> int:
        """Depth of the innermost open element of these tags; 0 if there is none."""
        return max((self.depths[t][-1] for t in tags if self.depths[t]), default=0)

    def outermost(self, tags, below: int) -> int:
        """Depth of the outermost open element of these tags that is deeper than `below`; 0 if there is none."""
        own = [d[i] for t in tags if (d := self.depths[t]) and (i := bisect_right(d, below)) < len(d)]
        return min(own, default=0)

    def close(self, depth: int) -> None:
        """Close the element at this depth and all inside it."""
        while len(self.stack) > depth:
            self.depths[self.stack.pop().tag].pop()

    def add(self, node: Node) -> None:
        self.depths[node.tag].append(len(self.stack))
        self.stack.append(node)


def parse(page: str) -> Node:
    """The element tree of a page, with its text between the elements. Never fails: what is no markup is text."""
    root = Node("html", None)
    at = _Open(root)
    pos, end, lower = 0, len(page), None
    find = _TOKEN.search
    while pos < end:
        m = find(page, pos)
        items = at.stack[-1].items
        if m is None:
            items.append(page[pos:])
            break
        if m.start() > pos:
            items.append(page[pos : m.start()])
        pos = m.end()
        if m["cdata"] is not None:
            items.append(m["cdata"].replace("&", "&amp;"))
        elif m["start"] is not None:
            tag, attrs = m["start"].lower(), m["attrs"]
            if tag in ("html", "body"):
                continue
            if tag in RAW:
                if not attrs.endswith("/"):
                    if lower is None:
                        lower = page.lower()
                        if len(lower) != end:  # a letter whose lower case is longer
                            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)").search(lower, pos)
                    pos = close.end() if close else end
                continue
            if tag in ENDS_P and (p := at.last(("p",))) > at.last(("button", "table")):
                at.close(p)
            if tag in ENDS:
                close_, limit = ENDS[tag]
                if outer := at.outermost(close_, at.last(limit)):
                    at.close(outer)
            parent = at.stack[-1]
            node = Node(tag, parent, _dropped(tag, attrs, at.last(("article", "main")) > 0))
            parent.items.append(node)
            if tag not in VOID and not (attrs.endswith("/") and tag in ("svg", "path")):
                at.add(node)
        elif m["end"] is not None:
            tag = m["end"].lower()
            if tag in ("html", "body"):
                continue
            if tag == "br":
                items.append(Node("br", at.stack[-1]))
                continue
            depth = at.last((tag,))
            if depth and (tag in BLOCK or depth > at.last(("table", "td", "th"))):
                at.close(depth)
    return root


def drops(chosen: Node) -> set[Node]:
    """Elements inside the chosen one that go. A word of a name takes no article or main part along, and no names take the whole text."""
    nodes = _in_order(chosen)[1:]
    holds: set[Node] = set()
    for n in reversed(nodes):
        if n in holds or n.tag in ("article", "main"):
            holds.add(n.parent)
    named = {n for n in nodes if n.drop == NAMED and n not in holds}
    sure = {n for n in nodes if n.drop == SURE}
    return sure | named if text_of(chosen, sure | named) else sure


def _in_order(root: Node) -> list[Node]:
    """All elements below and with root, each before its descendants."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        n.kids = [x for x in n.items if isinstance(x, Node)]
        todo.extend(n.kids)
    return out


def measure(root: Node) -> list[Node]:
    """Composite text density and the sum of the children's, for every element."""
    nodes = _in_order(root)
    for n in reversed(nodes):
        n.chars = sum(len("".join(x.split())) for x in n.items if isinstance(x, str))
        for k in n.kids:
            n.chars += k.chars
            n.tags += k.tags + 1
            n.link_chars += k.link_chars
            n.link_tags += k.link_tags + (k.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    share = root.link_chars / max(1, root.chars)
    for n in nodes:
        tags, links = max(1, n.tags), max(1, n.link_tags)
        base = math.log(n.chars * n.link_chars / max(1, n.chars - n.link_chars) + share * n.chars + math.e)
        ratio = n.chars / max(1, n.link_chars) * tags / links
        n.density = n.chars / tags * max(0.0, math.log(ratio) / base) if ratio > 0 else 0.0
    for n in nodes:
        n.total = sum(k.density for k in n.kids)
    return nodes


def main_node(nodes: list[Node]) -> tuple[Node, float]:
    """The element with the largest sum of its children's densities, of those that hold a block, ties to the first on the page; and the threshold."""
    holding = (n for n in nodes if n.chars and any(k.tag in BLOCK and k.chars for k in n.kids))
    best = max(holding, key=lambda n: (n.total, n.chars), default=nodes[0])
    threshold, n = best.density, best
    while n is not None:
        threshold, n = min(threshold, n.density), n.parent
    return best, threshold


def text_of(node: Node, gone: set[Node]) -> str:
    """Text of the blocks of an element in page order, without the elements in gone."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(html.unescape(x) if "&" in x else x)
            continue
        if x is None:
            out.append(" ")
            continue
        if x in gone:
            continue
        block = x.tag in BLOCK
        if block:
            out.append(" ")
            todo.append(None)
        todo.extend(reversed(x.items))
    return " ".join("".join(out).split())


def extract(page: str | None) -> str:
    """Main text of a page; empty for null, for an empty page, or if there is no text."""
    if not page:
        return ""
    nodes = measure(parse(page))
    chosen, threshold = main_node(nodes)
    menus = {n for n in _in_order(chosen) if n.tag in LISTS and n.link_tags and n.density <= threshold and n is not chosen}
    return text_of(chosen, drops(chosen) | menus)


OUT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages; other columns are not read. Works row by row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], names=OUT.names)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, OUT)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
SQL: dict[str, str] = {}
