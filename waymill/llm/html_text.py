"""Main text of HTML pages by composite text density.

A page becomes a tree without scripts, styles, forms, menus, headers, footers and sidebars (by element or role) and,
outside of an article, without what its class or id calls a notice, an advert, comments and the like. Every node
gets its composite density: characters per tag, lowered where much of the text is links. The density sum of a node
adds those of its children. The least density on the path from the body to the node with the largest sum is the
threshold. From the body down, whatever reaches it gives its subtree with the largest sum, and so do its children
beside that. Headings beside a subtree go with it. Within an article a class or an id decides nothing alone: a block
that it marks goes if its density is below the threshold.

Null, empty or textless html gives an empty text. Pages may be of any length and cut off anywhere; each row is
extracted alone, so repeated rows and ids stay as they are. An empty table gives an empty result. Other columns are
left behind, whatever their names.
"""

from __future__ import annotations

import html
import re
from math import e as E
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that hold no article text.
DROPPED = frozenset("script style noscript iframe template svg canvas head title nav footer aside form button select textarea dialog menu object audio video map".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: What a start tag ends, and the elements beyond which it doesn't reach.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tr": ("tr", ("table",)), "option": ("option", ("select",))}
#: Elements that only dress the text of the element they stand in; they are no nodes and count as no tags.
INLINE = frozenset("abbr b bdi bdo big br cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Words of a class or an id that tell what is no article text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies respond widget toolbar pagination pager skip".split()
)
#: Marks that count only outside an article.
OUTSIDE = frozenset(["header", "topbar", "top"])

#: A comment, a declaration, a tag whose quotes are closed, any other tag. What a tag has taken it doesn't give back,
#: so that the time for a page grows with its length.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[^a-z0-9]+")

EXTRACTED = "page_id long, url string, text string"
_EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


class Node:
    __slots__ = ("tag", "parent", "parts", "marked", "chars", "tags", "link_chars", "link_tags", "density", "total", "top")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts, self.marked = tag, parent, [], False  # parts: texts and nodes, in page order


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool | None:
    """Whether an element holds no article text; None: only its density can tell."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or not attributes.strip() or tag in ("html", "body", "article", "main"):
        return False
    out = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            words = set(WORD.split(value))
            if not in_article and words & (MARKS | OUTSIDE):
                return True
            if words & MARKS:
                out = None
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return out


def parse(page: str) -> Node:
    """The tree of a page without what is no article text."""
    root = Node("body", None)
    stack: list[tuple[str, Node | None]] = [("", root)]  # None: below an unwanted element
    in_article, at, end = 0, 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        node = stack[-1][1]
        if text and node is not None:
            node.parts.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        tag, attributes = (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if not tag:
            continue
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    in_article -= sum(t in ("article", "main") for t, _ in stack[i:])
                    del stack[i:]
                    break
            else:
                if tag == "p" and node is not None:
                    node.parts.append(Node("p", node))  # an end alone is an empty paragraph
            continue
        if tag in BLOCKS:
            in_article -= _end(stack, ("p",), ("table", "td", "th", "button", "object", "caption"))
        if tag in ENDS:
            in_article -= _end(stack, tuple(ENDS[tag][0].split()), ENDS[tag][1])
        node = stack[-1][1]
        unwanted = True if node is None else _unwanted(tag, attributes, in_article > 0)
        own = None if unwanted else node if tag in ("html", "body") or tag in INLINE and unwanted is False else Node(tag, node)
        if tag == "br" and own is not None:
            node.parts.append(" ")
        if own is not None and own is not node:
            own.marked = unwanted is None
            node.parts.append(own)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW and tag not in ("a", "b", "i", "span"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if own is not None:
                own.parts.append(page[at : close.start() if close else end])
            at = close.end() if close else end
            continue
        in_article += tag in ("article", "main")
        stack.append((tag, own))
    return root


def _end(stack: list, tags: tuple, beyond: tuple) -> int:
    """Ends the innermost of tags if nothing of beyond stands before it; articles that end with it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] in tags:
            ended = sum(t in ("article", "main") for t, _ in stack[i:])
            del stack[i:]
            return ended
        if stack[i][0] in beyond or stack[i][0] in ("article", "main", "div", "section", "ul", "ol", "nav", "body"):
            break
    return 0


def measure(root: Node) -> list[Node]:
    """Densities and density sums of all nodes; the nodes, each after those above it."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.parts if isinstance(x, Node)]
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for x in node.parts:
            if isinstance(x, Node):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
            else:
                node.chars += len("".join(x.split()))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags
    chars, links = max(1, root.chars), root.link_chars
    for node in order:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        free = max(1, c - lc)
        node.density = c / t * max(0.0, log(max(1.0, c / max(1, lc) * t / lt)) / log(log(c / free * lc + links / chars * c + E) + E - 1)) if c else 0.0
    for node in order:
        node.total = sum(x.density for x in node.parts if isinstance(x, Node))
    for node in reversed(order):
        node.top = node  # the subtree of the greatest sum in this one
        for x in reversed(node.parts):
            if isinstance(x, Node) and x.top.total > node.top.total:
                node.top = x.top
    return order


def selected(root: Node) -> list[Node]:
    """The subtrees that hold the article, in page order. Marked blocks of an article that are below the threshold lose their text."""
    order = measure(root)
    if not root.chars:
        return []
    best = max(order, key=lambda x: x.total)
    if not best.total:
        best = root
    threshold, node = best.density, best
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.parent
    for x in order:
        if x.marked and x.density < threshold:
            x.parts.clear()
    chosen, todo = set(), [root]
    while todo:
        x = todo.pop()
        if x not in chosen and x.chars and x.density >= threshold:
            chosen.add(root if best is root else x.top)
            todo += [y for y in x.parts if x.top is not x and isinstance(y, Node)]
    for x in reversed(order):  # those above come first, so a lift can go on
        if x not in chosen and _lifted(x, chosen):
            chosen.add(x)
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x in chosen:
            out.append(x)
        else:
            todo += [y for y in reversed(x.parts) if isinstance(y, Node)]
    return out or [best]


def _lifted(x: Node, chosen: set) -> bool:
    """Whether all that x holds beside chosen children are headings, one at least."""
    if x.tag == "body" or any(isinstance(y, str) and y.strip() for y in x.parts):
        return False
    own = [y for y in x.parts if isinstance(y, Node) and y.chars]
    return any(y in chosen for y in own) and any(y.tag in HEADINGS for y in own) and all(y in chosen or y.tag in HEADINGS for y in own)


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below nodes, white space as one blank."""
    out: list[str] = []
    run: list[str] = []

    def ended():
        if run and (text := " ".join("".join(run).split())):
            out.append(text)
        run.clear()

    for top in nodes:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                ended()
            elif isinstance(x, str):
                run.append(x)
            else:
                block = x.tag in BLOCKS
                if block:
                    ended()
                    todo.append(None)
                todo += reversed(x.parts)
        ended()
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks(selected(parse(page)))) if page else ""


def extracted(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url and text of every page."""

    def make(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=_EXTRACTED)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html")).mapInArrow(make, EXTRACTED)
