"""A small tolerant DOM: elements that can hold blocks, and the text blocks in them.

Inline elements make no nodes; their text belongs to the block around them, and text in
links is counted apart. A block is an unbroken run of inline text within one element."""

from __future__ import annotations

import html
import re
from collections import Counter

# fixed values: HTML element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template head title select option optgroup datalist textarea button".split())
RAW = frozenset("script style textarea title template".split())
#: Formulas and the text that stands in for media and scripts belong to the block around.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var nobr center "
                   "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle mspace mpadded mphantom menclose msub msup "
                   "msubsup munder mover munderover mtable mtr mtd semantics annotation "
                   "noscript iframe object audio video canvas map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag of the key ends open elements of the value, up to an enclosing list or table.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
        "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"),
        "thead": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
FENCE = frozenset("ul ol dl table".split())

#: A quote opens a quoted value only right after '=', if it is closed at all; any other is a
#: plain character. Possessive, so that no tag is gone over twice.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:[\s/]|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)", re.S)
#: Raw text ends at its end tag, which may hold more than its name; templates may hold others.
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_TEMPLATE = re.compile(r"<(/?)template(?=[\s/>])[^>]*(?:>|\Z)", re.I)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMED = ("class", "id", "role", "itemprop", "aria-label", "hidden", "aria-hidden", "style", "name")


class Node:
    """An element (text is None) or a text block."""

    __slots__ = ("tag", "attrs", "parent", "depth", "text", "links", "inline_tags")

    def __init__(self, tag: str, attrs: str, parent: int, depth: int, text: str | None = None, links: int = 0):
        self.tag, self.attrs, self.parent, self.depth, self.text, self.links = tag, attrs, parent, depth, text, links


def attributes(raw: str) -> str:
    """The values that say what an element is for, in lower case."""
    if not raw or "=" not in raw and "hidden" not in raw:
        return ""
    out = []
    for m in _ATTR.finditer(raw):
        name = m[1].lower()
        if name in _NAMED:
            value = m[2] or m[3] or m[4] or ""
            if name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    out.append("is-hidden")
            elif name == "hidden" or name == "aria-hidden":
                if value.lower() != "false":
                    out.append("is-hidden")
            else:
                out.append(value)
    return " ".join(out).lower()


def parse(page: str | None) -> list[Node]:
    """The nodes of a page in page order; parents stand before children. The first node is
    the root."""
    nodes = [Node("#root", "", -1, 0)]
    # open elements: (tag, node index); inline elements keep the index of the block around
    stack: list[tuple[str, int]] = [("#root", 0)]
    run: list[str] = []
    state = [0, 0]  # open links, characters in links
    # so that no end tag searches for what is not open: open blocks by tag, where they are in
    # the stack, and of each the open inline elements in it
    open_blocks: Counter = Counter()
    blocks_at = [0]
    open_inline: list[Counter] = [Counter()]

    def close_block() -> None:
        text = " ".join("".join(run).split()) if run else ""
        run.clear()
        if text:
            at = stack[-1][1]
            nodes.append(Node("#text", "", at, nodes[at].depth + 1, text, min(state[1], len(text))))
        state[1] = 0

    def add(piece: str) -> None:
        piece = html.unescape(piece) if "&" in piece else piece
        run.append(piece)
        if state[0]:
            state[1] += len(piece.strip())

    def pop_to(k: int) -> None:
        """Closes the open elements from position k on."""
        if any(t not in INLINE for t, _ in stack[k:]):
            close_block()
        while len(stack) > k:
            t, _ = stack.pop()
            if t in INLINE:
                open_inline[-1][t] -= 1
                state[0] -= t == "a"
            else:
                open_blocks[t] -= 1
                blocks_at.pop()
                open_inline.pop()

    def raw_end(tag: str, at: int) -> int:
        """Where an element of raw text that begins at ``at`` ends."""
        depth = 1
        while tag == "template":
            m = _TEMPLATE.search(page, at)
            if m is None:
                return len(page)
            depth, at = depth + (-1 if m[1] else 1), m.end()
            if not depth:
                return at
        m = _RAW_END[tag].search(page, at)
        return m.end() if m else len(page)

    page = page or ""
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # a closing tag; an inline one does not reach out of its block
            if open_inline[-1][tag] if tag in INLINE else open_blocks[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop_to(k)
            continue
        if tag in RAW:
            at = raw_end(tag, at)
            continue
        if tag == "br" or tag == "wbr":
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            continue
        if tag in INLINE:
            if not m[0].endswith("/>"):
                stack.append((tag, stack[-1][1]))
                open_inline[-1][tag] += 1
                state[0] += tag == "a"
            continue
        # a block: ends open paragraphs and what its kind ends
        around = stack[blocks_at[-1]][0]
        if around == "p" or around in HEADINGS and tag in HEADINGS:
            pop_to(blocks_at[-1])
        if tag in ENDS and any(open_blocks[t] for t in ENDS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in FENCE:
                    break
                if stack[k][0] in ENDS[tag]:
                    pop_to(k)
                    if tag not in ("tr", "tbody", "thead", "tfoot"):
                        break
        close_block()
        up = stack[-1][1]
        nodes.append(Node(tag, attributes(m[3] or ""), up, nodes[up].depth + 1))
        if not m[0].endswith("/>"):
            open_blocks[tag] += 1
            blocks_at.append(len(stack))
            open_inline.append(Counter())
            stack.append((tag, len(nodes) - 1))
    close_block()
    return nodes
