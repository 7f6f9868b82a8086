"""Main text of HTML pages by tree scoring.

A page is read into a tree; parts that are never article text (scripts, menus, forms, asides, elements whose class, id or
role says advert, notice, sidebar, comments and the like) are left out. Every paragraph gives points for its
length and its commas to its ancestors, less with the distance; so does every run of text and inline elements that stands directly
in another block, up to a block or line break. An element's points are discounted by its link
density. The best container is kept together with those of its siblings that read like text, and with what lies between
these and is not mostly links; their blocks are put out in page order.

Defined cases: null or empty html gives the empty text; elements whose end tags may be left out (paragraphs, items, cells, rows,
head and body) end as in browsers, inside the parts that are left out as well; end tags without a start are ignored;
character references are decoded text by text; form controls go without splitting the line they stand in; a page without any scored
text gives the text of its body; a null page_id or url is passed on; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm import textkernel as tk
from chronoframe.llm.common import small_batches

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title".split())
DROPPED = frozenset("nav footer aside form button dialog menu noscript template object select datalist canvas audio video annotation".split()) | RAW
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup svg "
    "time tt u var button select datalist textarea object canvas audio video iframe script style template annotation".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td dd li figcaption".split()) | HEADINGS
BLOCK = PARAGRAPHS | frozenset(
    "address article aside body caption center details dialog dir div dl dt fieldset figure footer form header hgroup hr legend main menu nav ol "
    "search section summary table tbody tfoot th thead tr ul".split()
)
CELLS, GROUPS, TABLE = frozenset("td th".split()), frozenset("tbody thead tfoot".split()), frozenset(["table"])
LISTED = frozenset("address div p li dt dd".split())
# What the start of an element ends (the nearest such element), and what keeps it from being looked for further up.
ENDS = {
    "li": (frozenset(["li"]), BLOCK - LISTED), "dt": (frozenset("dt dd".split()), BLOCK - LISTED), "dd": (frozenset("dt dd".split()), BLOCK - LISTED),
    "td": (CELLS, TABLE | {"tr"}), "th": (CELLS, TABLE | {"tr"}), "tr": (frozenset(["tr"]), TABLE),
    "tbody": (GROUPS, TABLE), "thead": (GROUPS, TABLE), "tfoot": (GROUPS, TABLE),
}
IN_TABLES = CELLS | GROUPS | TABLE | frozenset("tr caption".split())
# Words of class, id and role that mark what is not article text.
NEGATIVE = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie "
    "cookies copyright disclaimer discussion disqus footer footnav form gdpr login masthead menu modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing shoutbox sidebar "
    "signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets complementary contentinfo "
    "alert warning paywall".split()
)
POSITIVE = frozenset("article body content entry main page post story text".split())
# Of those against, the ones that count even beside one in favour; and words that turn a name like with-sidebar around.
STRONG = frozenset("ad ads advert advertisement comment comments".split())
NEGATING = frozenset("with has no without".split())

# A quote in a tag counts after an equals sign only; a comment may be empty or end in --!>.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|$))|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|$)",
    re.S,
)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Break(str):
    """The white space of a line break."""


BREAK = Break(" ")


class Node:
    __slots__ = ("tag", "parent", "block", "dropped", "children", "score", "chars", "linked", "positive")

    def __init__(self, tag: str, parent: Node | None, positive: bool = False, dropped: bool = False):
        self.tag, self.parent, self.positive, self.dropped = tag, parent, positive, dropped
        # An element of no known name is a block where blocks may stand.
        self.block = tag in BLOCK or tag not in INLINE and (parent is None or parent.block and parent.tag not in PARAGRAPHS)
        self.children: list = []  # nodes and, for text, strings
        self.score = 0.0
        self.chars = self.linked = 0


def _judged(attributes: str) -> tuple[bool, bool]:
    """Whether class, id and role say that an element is not article text; whether they say that it is."""
    if _HIDDEN.search(attributes):
        return True, False
    against, strongly, favour = False, False, False
    for found in _MARKS.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").lower().split():
            words = set(_WORD.findall(name))
            if words & NEGATIVE and not words & NEGATING:
                against, strongly = True, strongly or bool(words & STRONG)
            elif words & POSITIVE:
                favour = True
    return against and (strongly or not favour), favour


def tree(page: str) -> Node:
    """The page without the parts that are never text, which are read like others but hang on nothing."""
    root = Node("body", None)
    open_nodes, at = [root], 0
    opened: Counter[str] = Counter()

    def close(up: int) -> None:
        opened.subtract(n.tag for n in open_nodes[up:])
        del open_nodes[up:]

    def end(names, stops) -> None:
        """Close the nearest open element of these names, if none of the others lies above it."""
        if any(opened[name] for name in names):
            for up in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[up].tag in names:
                    return close(up)
                if open_nodes[up].tag in stops:
                    return None
        return None

    while at < len(page):
        found = _TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text and not open_nodes[-1].dropped:
            open_nodes[-1].children.append(html.unescape(text))
        if not found:
            break
        at = found.end()
        if found[1] and not open_nodes[-1].dropped:
            open_nodes[-1].children.append(found[1])
        if not found[3]:
            continue
        tag, closing, attributes = found[3].lower(), bool(found[2]), found[4]
        if tag in ("html", "head", "body"):
            continue
        if closing:
            inner = BLOCK - {tag} if tag not in BLOCK or tag == "p" else frozenset(["ul", "ol"]) | IN_TABLES if tag == "li" else TABLE if tag in IN_TABLES else IN_TABLES
            end((tag,), inner - {tag})
            continue
        top = open_nodes[-1]
        if tag in VOID:
            top.children.append(BREAK if tag == "br" else " " if tag == "wbr" else "")
            if tag == "hr":
                end(("p",), BLOCK)
                open_nodes[-1].children.append(Node("hr", open_nodes[-1]))
            continue
        if tag in BLOCK:
            if tag not in IN_TABLES or tag == "table":
                end(("p",), BLOCK - {"p"})
            if tag in ENDS:
                end(*ENDS[tag])
            top = open_nodes[-1]
        if not top.dropped:
            negative, positive = _judged(attributes) if attributes else (False, False)
            negative = negative and tag not in ("article", "main")
            dropped = tag in DROPPED or negative or tag == "header" and not opened["article"] and not opened["main"]
        else:
            dropped, positive = True, False
        node = Node(tag, top, positive or tag in ("article", "main"), dropped)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s>/]|$)", re.I).search(page, at)
            at = stop.start() if stop else len(page)
            if stop:
                last = page.find(">", at)
                at = last + 1 if last >= 0 else len(page)
        elif not attributes.endswith("/") or tag in PARAGRAPHS or tag in INLINE and tag not in DROPPED:
            open_nodes.append(node)
            opened[tag] += 1
        if not dropped:
            top.children.append(node)
        elif node.block and not top.dropped:
            top.children.append(Node("hr", top))
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, at = [root], 0
    while at < len(out):
        out.extend(c for c in out[at].children if isinstance(c, Node))
        at += 1
    return out


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        own = sum(len(_SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        node.chars += own
        if node.tag == "a":
            node.linked = node.chars
        if node.parent:
            node.parent.chars += node.chars
            node.parent.linked += node.linked


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _commas(node: Node) -> int:
    total, rest = 0, [node]
    while rest:
        for c in rest.pop().children:
            if isinstance(c, str):
                total += c.count(",") + c.count("，") + c.count("、")
            elif not c.block:
                rest.append(c)
    return total


def _runs(children: list, breaks: bool) -> list[list]:
    """Children in runs of text and inline elements (that end at line breaks, too) and each block alone."""
    out, run = [], []
    for c in children:
        block = isinstance(c, Node) and c.block
        if not block:
            run.append(c)
        if run and (block or breaks and isinstance(c, Break)):
            out.append(run)
            run = []
        if block:
            out.append([c])
    return [*out, run] if run else out


def _gathered(run: list) -> Node:
    """A run as a measured node of its own."""
    node = Node("div", None)
    node.children = run
    for c in run:
        node.chars += len(_SPACE.sub(" ", c).strip()) if isinstance(c, str) else c.chars
        node.linked += 0 if isinstance(c, str) else c.linked
    return node


def _give_points(part: Node, up: Node | None) -> None:
    """The points of a paragraph or run for the element that holds it and those above."""
    points, share = (1 + _commas(part) + min(part.chars / 100, 3)) * (1 - _density(part)), 1.0
    for distance in range(4):
        if up is None:
            break
        up.score += points * share
        up, share = up.parent, 1 / (2 * (distance + 1))


def best_containers(root: Node) -> list[Node]:
    nodes = _nodes(root)
    _measure(nodes)
    for node in nodes:
        if not node.chars or not node.block:
            continue
        if node.tag in PARAGRAPHS:
            _give_points(node, node.parent)
            continue
        for run in _runs(node.children, True):
            if isinstance(run[0], str) or not run[0].block:
                part = _gathered(run)
                if part.chars:
                    _give_points(part, node)
    best, most = None, 0.0
    for node in nodes:
        if node.tag in PARAGRAPHS or not node.block or not node.score:
            continue
        value = (node.score + 25 * node.positive) * (1 - _density(node))
        if value > most:
            best, most = node, value
    if best is None:
        return [root]
    while best.tag in IN_TABLES - TABLE and best.parent is not None:  # the whole table, not its longest row
        best = best.parent
    while best.parent is not None and best.tag in ("section", "ul", "ol", "table", "tbody", "tr", "div") and best.parent.positive:
        best = best.parent
    if best.parent is None:
        return [best]
    parts = []
    for run in _runs(best.parent.children, False):
        bare = isinstance(run[0], str) or not run[0].block
        other = _gathered(run) if bare else run[0]
        if not other.chars:
            continue
        value = (other.score + 25 * other.positive) * (1 - _density(other))
        text = (bare or other.tag in PARAGRAPHS) and _density(other) < 0.25 and (other.chars > 80 or other.tag in HEADINGS)
        parts.append((other, other is best or value >= max(10, most / 5) or text))
    kept = [at for at, (_, keep) in enumerate(parts) if keep]
    return [other for other, keep in parts[kept[0] : kept[-1] + 1] if keep or _density(other) < 0.5]


def blocks(container: Node) -> Iterator[str]:
    """The text of each block, white space made one."""
    line: list[str] = []
    stack: list = [iter([container])]
    closes: list[bool] = [False]

    def flush():
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        return text

    while stack:
        item = next(stack[-1], None)
        if item is None:
            stack.pop()
            if closes.pop() and (text := flush()):
                yield text
        elif isinstance(item, str):
            line.append(item)
        else:
            block = item.block
            if block and (text := flush()):
                yield text
            stack.append(iter(item.children))
            closes.append(block)
    if text := flush():
        yield text


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(text for part in best_containers(tree(page)) for text in blocks(part))


def extract(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars; a map over rows."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_column), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, "html"):
                texts = [main_text(page) for page in part.column(2).to_pylist()]
                arrays = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [id_column, "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"`{id_column}` {kind}, url string, text string, n_chars long")
