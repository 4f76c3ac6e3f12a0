"""A small tolerant HTML reader: block elements as a tree, and the text blocks between their tags."""

from __future__ import annotations

import html
import re

# Fixed names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text. Of those without an end tag the first two go on to the end of the page (as HTML says), of the others only the tag goes.
RAW = frozenset("script style textarea title iframe template select svg".split())
ENDLESS = frozenset("script style".split())
BLOCK = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend address details summary dialog hgroup center menu search label button option noscript".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("label button option noscript html body td th tr thead tbody tfoot caption".split()) | {"hr"}
#: Start tags that end an open element of the same group.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Ends of those groups: an open element beyond these isn't touched.
BOUND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TOKEN = re.compile(r"<!--|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^>\"'])*+|[^>]*)>|<[!?][^>]*>")
_ATTRIBUTE = re.compile(r"\b(id|class|role|itemprop|property|rel|hidden|style|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "text", "linked", "marks", "inputs", "index")

    def __init__(self, tag: str, tokens: str, parent: Node | None) -> None:
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.children: list[Node] = []
        self.text = ""  # of text blocks only (tag "")
        self.linked = self.marks = self.inputs = 0
        self.index = 0
        if parent is not None:
            parent.children.append(self)


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in page order. Text blocks are leaves without a tag."""
    root = Node("html", "", None)
    stack, nodes = [root], [root]
    pieces: list[str] = []
    links = linked = marks = inputs = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked, marks
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                leaf = Node("", "", stack[-1])
                leaf.text, leaf.linked, leaf.marks = text, min(linked, len(text)), marks
                nodes.append(leaf)
        linked = marks = 0

    def close(to: int) -> None:
        flush()
        del stack[to:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            pieces.append(page[at:])
            break
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = 0
            elif tag in BLOCK:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                else:
                    flush()
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else n if tag in ENDLESS else at
            continue
        if tag in ("html", "head"):
            flush()
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCK or tag == "hr":
            flush()
            if tag in ENDS_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        del stack[i:]
                        break
                    if stack[i].tag in ("td", "th", "table", "button"):
                        break
            if tag in SAME:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in SAME[tag]:
                        del stack[i:]
                        break
                    if stack[i].tag in BOUND[tag]:
                        break
            tokens = " ".join(v.strip("\"'").lower() for _, v in _ATTRIBUTE.findall(m[3])) if m[3] else ""
            if tag != "hr":
                node = Node(tag, tokens, stack[-1])
                nodes.append(node)
                if not m[3].endswith("/"):
                    stack.append(node)
        elif tag == "a":
            links = 1
        elif tag == "input":
            stack[-1].inputs += 1
        elif tag not in VOID:
            marks += 1
    flush()
    for i, node in enumerate(nodes):
        node.index = i
    return root, nodes
