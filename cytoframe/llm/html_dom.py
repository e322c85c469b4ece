"""A lenient tree of the block elements of an HTML page, in one pass over its tags."""

from __future__ import annotations

import html
import re

#: A comment, declaration or processing instruction, or a tag with its attributes; quoted values may hold ">".
TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOKEN = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")

#: Elements whose content is never text of the page: scripts and styles, what is shown only without scripts or frames, the window's title, and form controls.
RAW = frozenset("script style noscript template iframe title textarea select".split())
BLOCKS = frozenset(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset nav header footer aside"
    " blockquote pre figure figcaption address details summary hgroup menu dialog center option button label legend".split()
)
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: A start tag of the key ends open elements of the value, up to the nearest of the scope.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "body": frozenset(["head"]), "option": frozenset(["option"]),
}
SCOPE = frozenset(["ul", "ol", "dl", "menu", "table", "html", "body", "article", "section", "div", "main", "nav", "aside", "form"])
NOT_IN_P = BLOCKS - {"button", "label", "option", "legend"}


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "texts", "links", "controls", "hidden", "order")

    def __init__(self, tag: str, tokens: frozenset[str], parent: Node | None, hidden: bool = False):
        self.tag, self.tokens, self.parent, self.hidden = tag, tokens, parent, hidden
        self.children: list[Node] = []
        #: (order, words joined by spaces) of the node's own runs of text between its children
        self.texts: list[tuple[int, str]] = []
        self.links, self.controls, self.order = 0, 0, 0


def tokens_of(attributes: str) -> tuple[frozenset[str], bool]:
    """Words of class, id, role and like attributes; whether the element is hidden."""
    found: set[str] = set()
    hidden = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role", "data-component"):
            found.update(TOKEN.findall(CAMEL.sub(r"\1 \2", html.unescape(value)).lower()))
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hidden = True
    return frozenset(found), hidden


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; the first is a root that holds the page."""
    root = node = Node("root", frozenset(), None)
    nodes, order, at, n = [root], 0, 0, len(page)
    buffer: list[str] = []
    in_link = 0

    def flush() -> None:
        nonlocal order
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                node.texts.append((order, text))
                order += 1
            buffer.clear()

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            rest = page[at:]
            buffer.append(rest)
            break
        if m.start() > at:
            piece = page[at : m.start()]
            buffer.append(piece)
            if in_link:
                node.links += len(piece)
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag, closing = name.lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                if tag in ("textarea", "select"):
                    node.controls += 1
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                buffer.append(" ")
            elif tag == "input":
                node.controls += 1
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag not in BLOCKS:
            continue
        if closing:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                flush()
                node = up.parent
            elif tag == "p":
                flush()
            continue
        flush()
        in_link = in_link if tag in ("div", "p", "h1", "h2", "h3", "h4", "h5", "h6") else 0
        if tag in NOT_IN_P:
            up = node
            while up.tag in ("button", "label", "option", "legend"):
                up = up.parent
            if up.tag == "p":
                node = up.parent
        ends = ENDS.get(tag)
        if ends:
            up = node
            while up is not root:
                if up.tag in ends:
                    node = up.parent
                    if tag != "tr":
                        break
                elif up.tag in SCOPE:
                    break
                up = up.parent
        if tag in ("html", "body") and any(x.tag == tag for x in nodes[:4]):
            continue
        tokens, hidden = tokens_of(m[3]) if m[3] else (frozenset(), False)
        child = Node(tag, tokens, node, hidden)
        child.order = order
        node.children.append(child)
        nodes.append(child)
        node = child
        if tag == "button":
            child.controls += 1
    flush()
    return nodes
