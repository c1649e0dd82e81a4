"""A small DOM: enough of HTML's tree building for text extraction."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot option optgroup legend".split())
#: An opening tag ends open elements of these names, up to the nearest of the names after the bar.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

#: A quote opens a value only after =; one that is never closed ends with its tag.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>|<[!?/][^>]*>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


@dataclass
class Node:
    tag: str
    names: str = ""
    role: str = ""
    #: Nodes and strings (decoded text), in page order.
    items: list = field(default_factory=list)

    @property
    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]

    @property
    def key(self) -> str:
        return f"{self.tag}|{self.names}|{self.role}" if self.names or self.role else self.tag


def _element(tag: str, rest: str) -> Node:
    node = Node(tag)
    if "=" in rest:
        names = []
        for kind, *values in _ATTRIBUTE.findall(rest):
            value = unescape(next((v for v in values if v), "")).strip().lower()
            if kind.lower() == "role":
                node.role = value
            elif value:
                names.append(value.replace("|", " "))
        node.names = " ".join(names)
    return node


def parse(html: str) -> Node:
    """The tree of a page. Broken markup is closed where the standard closes it, or at the end."""
    root = Node("#document")
    stack, at = [root], 0

    def pop_to(names: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in stop:
                return
            if stack[k].tag in names:
                del stack[k:]
                return

    while at < len(html):
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            stack[-1].items.append(unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            pop_to({tag}, {"article", "main", "body"} - {tag} if tag in ("b", "i", "em", "strong", "span", "a", "font", "u") else set())
            continue
        if tag in CLOSES_P:
            pop_to({"p"}, {"table", "td", "th", "button"})
        if tag in IMPLIED:
            pop_to(*IMPLIED[tag])
        node = _element(tag, m["rest"])
        stack[-1].items.append(node)
        if tag in VOID or m["rest"].endswith("/") and tag not in BLOCK | RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.IGNORECASE).search(html, at)
            raw = html[at : end.start() if end else len(html)]
            node.items.append(unescape(raw) if tag in ("title", "textarea") else raw)
            at = end.end() if end else len(html)
            continue
        stack.append(node)
    return root
