"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, halved at every step beyond the parent and discounted by the
share of the text that is link text. The best container and those siblings that score near it, or hold long unlinked paragraphs,
are kept. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are taken out first.

A name that merely contains a boilerplate word, one beside a name of main content, and a form may also belong to a wrapper of the whole page. Such an
element stays if it holds most of the page's unlinked text, or an article or main element with much of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by role (from the HTML standard), and words that name boilerplate in class, id or role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
DROPPED = frozenset("head script style noscript template iframe object svg math canvas nav header footer aside form button select textarea input label "
                    "dialog menu title audio video map xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rt rp rtc s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
PARAGRAPHS = frozenset("p pre blockquote li td dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|banner|promo|promotion|sponsor|sponsored|sponsors|sidebar|side|aside|menu|nav|navbar|navigation|"
    r"breadcrumbs?|header|masthead|footer|foot|cookies?|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"comments?|commentlist|disqus|respond|replies|reply|discussion|share|sharing|social|related|recommended|recommendations|widget|toolbar|pagination|pager|"
    r"search|form|hidden|skip|complementary|contentinfo|search|dialog|tags)(?:$|[\s_-])", re.IGNORECASE)
MAIN = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|main|story|body|text)(?:$|[\s_-])", re.IGNORECASE)
TOKEN = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+[^>]*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.IGNORECASE)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
SIBLING_SHARE = 0.2
MOST, MUCH = 0.5, 0.25  # of the page's unlinked text: what makes a wrapper of an element, and of one around an article


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "likely", "doubtful", "block", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, likely: bool = False, doubtful: bool = False) -> None:
        self.tag, self.parent, self.dropped, self.likely, self.doubtful = tag, parent, dropped, likely, doubtful
        self.block: Node = parent.block if parent is not None and tag in INLINE else self  # the nearest element that is not inline
        self.children: list[Node | str] = []
        self.score = 0.0
        self.chars = self.linked = 0


def _unwanted(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """(boilerplate, likely main, boilerplate unless it wraps the main text) by name and attributes."""
    if tag in DROPPED and tag != "form":
        return True, False, False
    dropped = likely = named = partly = False
    if attributes and not attributes.isspace():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN_STYLE.search(value):
                dropped = True
            elif name in ("class", "id", "role"):
                likely = likely or bool(MAIN.search(value))
                named = named or any(BOILERPLATE.fullmatch(v) for v in value.split())
                partly = partly or bool(BOILERPLATE.search(value))
    if tag in ("html", "body", "main"):
        return False, True, False
    if tag == "article":  # boilerplate only by a whole name (a reader's comment), not by a part such as "comments-open"
        return dropped or named, True, False
    dropped = dropped or named and not likely
    return dropped, likely, not dropped and (named or partly or tag == "form")


def parse(html: str) -> Node:
    """A tree of any markup: stray end tags are passed over, open elements close with their container, paragraphs at the next block."""
    root = node = Node("#root", None, False)
    at, n = 0, len(html)
    opened: Counter[str] = Counter()

    def closed(here: Node, last: Node) -> Node:
        """Closes all from `here` up to `last`; gives what is open then."""
        while here is not last:
            opened[here.tag] -= 1
            here = here.parent
        opened[last.tag] -= 1
        return last.parent

    while at < n:
        m = TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at:
            node.children.append(html[at:end])
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = closed(node, up)
            elif tag == "p":
                node.children.append(Node("p", node, False))  # as browsers do: an empty paragraph, which ends the block
            continue
        if tag not in INLINE:  # a block closes an open paragraph of the same container
            up = node.block
            if up.tag == "p" or tag == up.tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option") or tag in ("dt", "dd") and up.tag in ("dt", "dd"):
                node = closed(node, up)
        new = Node(tag, node, *_unwanted(tag, m[3]))
        node.children.append(new)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            at = close.end() if close else n
        elif tag not in VOID and not m[3].endswith("/") or tag in PARAGRAPHS:
            node = new
            opened[tag] += 1
    _settle_doubts(root)
    return root


def _settle_doubts(root: Node) -> None:
    """Drop the doubtful elements that wrap no main text."""
    order, stack, doubts = [], [(root, False)], False
    text: dict[int, int] = {}
    while stack:
        node, in_link = stack.pop()
        in_link = in_link or node.tag == "a"
        order.append(node)
        doubts = doubts or node.doubtful
        text[id(node)] = 0 if in_link else sum(len(c) for c in node.children if isinstance(c, str) and not c.isspace())
        stack.extend((c, in_link) for c in node.children if not isinstance(c, str) and not c.dropped)
    if not doubts:
        return
    largest: dict[int, int] = {}  # text of the largest article or main element at or below a node
    for node in reversed(order):
        if node.tag in ("article", "main"):
            largest[id(node)] = text[id(node)]
        if node.parent is not None:
            text[id(node.parent)] += text[id(node)]
            largest[id(node.parent)] = max(largest.get(id(node.parent), 0), largest.get(id(node), 0))
    total = text[id(root)]
    for node in order:
        if node.doubtful:
            node.dropped = not (text[id(node)] > MOST * total or largest.get(id(node), 0) > MUCH * total)


def blocks(node: Node) -> list[tuple[Node, str]]:
    """(block element, text) in page order; white space is one space, references are decoded, dropped elements are left out."""
    out: list[tuple[Node, str]] = []
    run: list[str] = []

    def flush(owner: Node) -> None:
        if run:
            text = " ".join(unescape("".join(run)).split())
            run.clear()
            if text:
                out.append((owner, text))

    # An explicit stack: pages can nest deeper than calls can.
    stack: list[tuple[Node, Node, int]] = [(node, node, 0)]
    while stack:
        here, owner, i = stack.pop()
        if i < len(here.children):
            child = here.children[i]
            stack.append((here, owner, i + 1))
            if isinstance(child, str):
                run.append(child)
            elif child.tag in INLINE:
                if not child.dropped:
                    if child.tag in ("br", "wbr", "img"):
                        run.append(" " if child.tag == "br" else "")
                    else:
                        stack.append((child, owner, 0))
            else:
                flush(owner)
                if not child.dropped:
                    stack.append((child, child, 0))
        elif here is owner:
            flush(owner)
    return out


def _measure(root: Node) -> list[Node]:
    """Fill chars and linked of every kept node; gives the kept nodes, parents first."""
    order, stack = [], [(root, False)]
    direct: list[tuple[Node, int, bool]] = []
    while stack:
        node, in_link = stack.pop()
        in_link = in_link or node.tag == "a"
        order.append(node)
        n = sum(len(c) for c in node.children if isinstance(c, str) and not c.isspace())
        direct.append((node, n, in_link))
        stack.extend((c, in_link) for c in node.children if not isinstance(c, str) and not c.dropped)
    for node, n, in_link in reversed(direct):
        node.chars += n
        node.linked += n if in_link else 0
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return order


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def main_text(html: str | None) -> str:
    """The blocks of the main text, joined by blank lines; empty for null, empty or text-free pages."""
    if not html:
        return ""
    root = parse(html)
    order = _measure(root)
    kept = blocks(root)
    if not kept:
        return ""
    scored: set[int] = set()
    nodes: list[Node] = []
    for owner, text in kept:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        up = owner.parent if owner.tag in PARAGRAPHS and owner.parent is not None else owner
        share = 1.0
        while up is not None and share >= 0.125:
            if id(up) not in scored:
                scored.add(id(up))
                nodes.append(up)
            up.score += points * share
            up, share = up.parent, share / 2
    place = {id(node): i for i, node in enumerate(order)}
    for node in nodes:
        node.score *= (1 - _density(node)) * (1.5 if node.likely and node.tag not in ("html", "body") else 1.0)
    best = max(nodes, key=lambda node: (node.score, -place[id(node)]))
    # Sections of one article are one text: the nearest article or main element around the best container stands for it.
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    if best.parent is None or best.tag in ("article", "main", "body", "html"):
        chosen = {id(best)}
        if best.tag == "article" and best.parent is not None:
            chosen |= {id(c) for c in best.parent.children if not isinstance(c, str) and c.tag == "article" and not c.dropped and c.score >= best.score * SIBLING_SHARE}
    else:
        chosen = {id(best)}
        for c in best.parent.children:
            if isinstance(c, str) or c.dropped:
                continue
            good = c.score >= best.score * SIBLING_SHARE and _density(c) < 0.3
            paragraph = c.tag in PARAGRAPHS and c.chars and _density(c) < 0.25
            if good or paragraph:
                chosen.add(id(c))
    held: set[int] = set()
    for node in order:  # parents first
        if id(node) in chosen or node.parent is not None and id(node.parent) in held:
            held.add(id(node))
    return "\n\n".join(text for owner, text in kept if id(owner) in held)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch.column("html").to_pylist()]
        names = [n for n in batch.schema.names if n != "html"]
        arrays = [*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*names, "text", "n_chars"])


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row per input row; n_chars counts code points.

    Null and empty pages, and pages without text outside boilerplate, have an empty text. Markup of any kind is read as far as it
    goes. Ties between containers go to the first in the page. Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", "n_chars")
