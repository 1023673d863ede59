"""A small DOM for main-text extraction: enough of HTML's rules to nest real pages, nothing for display."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
SPACE = re.compile(r"\s+")

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
# An opening tag of the first kind ends an open element of the second, up to the named borders.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_PARAGRAPH = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "body", "head", "html", "legend"}


@dataclass(slots=True)
class Node:
    """An element, or a text (tag ``#text``) with its decoded characters."""

    tag: str
    label: str
    text: str = ""
    children: list[Node] = field(default_factory=list)


def _label(tag: str, attributes: str) -> tuple[str, str]:
    """The element's name with its class and id words, by which elements are compared, and those words alone."""
    if not attributes.strip():
        return tag, ""
    words = []
    for name, double, single, bare in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            words += (double or single or bare).lower().split()
    words = " ".join(sorted(words))
    return f"{tag} {words}".strip(), words


def parse(html: str) -> Node:
    """The tree of a page. Comments and declarations vanish; raw-text elements keep no children."""
    root = Node("#root", "#root")
    stack = [root]
    at, length = 0, len(html)

    def add_text(raw: str) -> None:
        if raw:
            stack[-1].children.append(Node("#text", "#text", unescape(raw) if "&" in raw else raw))

    while at < length:
        token = TOKEN.search(html, at)
        if token is None:
            add_text(html[at:])
            break
        add_text(html[at : token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag in CLOSES:
            ends, borders = CLOSES[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in borders:
                    break
                if stack[depth].tag in ends:
                    del stack[depth:]
                    break
        elif tag in ENDS_PARAGRAPH:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCK:
                    break
        label, words = _label(tag, token[3])
        node = Node(tag, label, words)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else length
        elif tag not in VOID and not token[3].endswith("/"):
            stack.append(node)
    return root


def one_spaced(text: str) -> str:
    return SPACE.sub(" ", text).strip()
