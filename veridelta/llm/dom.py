"""A forgiving HTML tree: elements and text in page order."""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Raw elements whose references are decoded; none of them is ever main text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = RAW | frozenset("head svg math object audio video canvas select datalist button".split())
_CLOSES_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot li dd dt legend summary".split())
#: What an opening tag ends: the tags ended, and the tags that stop the search.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "body": (("head",), ()),
}
#: As in browsers a quote opens a value only behind ``=``; one that never closes is
#: a plain character, and the tag ends at the next ``>``.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>\x00]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>", re.S
)
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SCOPE = frozenset("table td th caption html button".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "depth", "start", "end")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0

    def attributes(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for name, a, b, c in _ATTR.findall(self.attrs):
            out.setdefault(name.lower(), unescape(a or b or c))
        return out


def parse(html: str) -> Node:
    """The tree of a page. Unclosed and stray tags are mended as browsers do in
    the common cases; comments, doctypes and processing instructions are gone."""
    root = Node("#root", "", None)
    node, at = root, 0
    lowered: str | None = None
    while True:
        m = _TOKEN.search(html, at)
        if not m:
            break
        if m.start() > at:
            node.items.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                node.items.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            up = node
            while up is not root and up.tag != tag:
                if tag not in BLOCK and up.tag in _SCOPE:
                    up = root
                    break
                up = up.parent
            if up is not root:
                node = up.parent
            elif tag == "p":
                node.items.append(Node("p", "", node))
            continue
        if tag in _CLOSES_P:
            up = node
            while up is not root and up.tag != "p" and up.tag not in _SCOPE:
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in _ENDS:
            ends, stops = _ENDS[tag]
            up, last = node, None
            while up is not root and up.tag not in stops:
                if up.tag in ends:
                    last = up
                    if tag not in ("tr", "tbody", "tfoot", "td", "th"):
                        break
                up = up.parent
            if last is not None:
                node = last.parent
        child = Node(tag, m[3], node)
        node.items.append(child)
        if tag in VOID:
            continue
        if tag in RAW:
            if lowered is None:
                lowered = html.lower() if html.isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), html)
            close = lowered.find(f"</{tag}", at)
            child.items.append(html[at : close if close >= 0 else len(html)])
            end = html.find(">", close) if close >= 0 else -1
            at = end + 1 if end >= 0 else len(html)
        elif not m[3].endswith("/") or tag in BLOCK:
            node = child
    if at < len(html):
        node.items.append(unescape(html[at:]))
    return root
