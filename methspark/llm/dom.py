"""A tolerant HTML tree: elements with parents, attribute tokens and text in order, in one pass over the tags."""

from __future__ import annotations

import html
import re

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'){0,1000}+)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_OPEN_TAG_AT_END = re.compile(r"<(?:[a-zA-Z/!?])[^>]*\Z")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text without tags, up to the closing tag.
RAW = frozenset("script style textarea title xmp noframes".split())
#: Their content is never shown as text of the page.
HIDDEN = frozenset("script style template iframe head title select datalist noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend optgroup option".split()
)
#: Start tags that end an open paragraph.
_ENDS_P = BLOCK - frozenset("html body dd dt li td th tr tbody thead tfoot caption legend optgroup option".split())
#: A start tag ends an open element of the same row, unless one of the scopes stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
_SCOPE_P = frozenset("table td th caption button object html body".split())


class Open:
    """The stack of open elements, with the places of each tag in it, so that a look-up doesn't walk the stack."""

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["#root"]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        if tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def last(self, tags: set[str] | frozenset) -> int:
        """The topmost place of any of the tags; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        """Close what is open from a place on."""
        for tag in self.tags[place:]:
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
        del self.nodes[place:], self.tags[place:]

    def close(self, tags: set[str], scope: frozenset | set) -> None:
        """Close the topmost of the tags, unless a tag of the scope stands above it."""
        place = self.last(tags)
        if place > self.last(scope):
            self.cut(place)

    def end(self, tag: str) -> None:
        """An end tag: it closes its element, but an inline one no block."""
        place = self.last({tag})
        if place and (tag in BLOCK or place > (self.blocks[-1] if self.blocks else 0)):
            self.cut(place)


class Tree:
    """Node 0 is the root. ``items`` holds, in page order, (node, text) and, for line breaks, (node, ' ')."""

    def __init__(self) -> None:
        self.tags, self.parents, self.tokens, self.truth = ["#root"], [-1], [()], [None]
        self.items: list[tuple[int, str]] = []

    def add(self, tag: str, parent: int, attributes: str) -> int:
        tokens: list[str] = []
        truth = None
        if attributes and "=" in attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                value = value.strip("\"'")
                if name == "data-y":
                    truth = value
                else:
                    tokens += _WORD.findall(_CAMEL.sub(" ", value).lower())
        self.tags.append(tag)
        self.parents.append(parent)
        self.tokens.append(tuple(tokens))
        self.truth.append(truth)
        return len(self.tags) - 1


def _text(raw: str) -> str:
    return html.unescape(raw) if "&" in raw else raw


def parse(page: str) -> Tree:
    """The tree of a page; unclosed, misplaced and cut-off tags are taken as browsers mostly do.

    Time is linear in the page. No tag ends after the last ``>``, so none is looked for there; a tag of over 1,000 quoted and unquoted pieces ends
    at its first ``>``.
    """
    tree = Tree()
    stack = Open()
    items = tree.items
    at, n, last = 0, len(page), page.rfind(">") + 1
    while True:
        m = _TAG.search(page, at, last)
        end = m.start() if m else n
        if m is None and (comment := page.find("<!--", max(at, last))) >= 0:
            end = comment
        if end > at:
            raw = page[at:end]
            if m is None:
                raw = _OPEN_TAG_AT_END.sub("", raw)
            if raw:
                items.append((stack.nodes[-1], _text(raw)))
        if m is None or m[0].startswith("<!--") and not m[0].endswith("-->"):
            return tree
        at = m.end()
        closing, tag = m[1], m[2] or m[4]
        if closing:
            closing = closing.lower()
            if closing == "br":
                items.append((stack.nodes[-1], " "))
            else:
                stack.end(closing)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in _ENDS_P:
            stack.close({"p"}, _SCOPE_P)
        if tag in _ENDS:
            stack.close(*_ENDS[tag])
        elif tag in ("body",):
            stack.close({"head"}, frozenset())
        attributes = (m[3] if m[2] else m[5]) or ""
        node = tree.add(tag, stack.nodes[-1], attributes)
        if tag == "br" or tag == "wbr":
            items.append((stack.nodes[-1], " " if tag == "br" else ""))
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])|\Z", re.I).search(page, at)
            if tag == "textarea" or tag == "title":
                items.append((node, _text(page[at : stop.start()])))
            at = page.find(">", stop.end()) + 1 or n if stop.end() > stop.start() else n
        elif tag not in VOID and not attributes.endswith("/"):
            stack.push(node, tag)
        elif tag not in VOID and tag in BLOCK:
            stack.push(node, tag)  # a slash means nothing in HTML elements
