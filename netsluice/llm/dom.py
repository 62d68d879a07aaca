"""A forgiving reader of HTML into block-level nodes with their runs of text, in time linear in the page."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter

# Element names by their role in HTML.
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption nav "
    "header footer aside form fieldset figure figcaption blockquote pre address details summary dialog center menu hr "
    "hgroup search noscript object audio video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page: scripts, styles, form controls, drawings, and what stands for other pages.
DROPPED = frozenset(
    "script style head template iframe svg canvas map select textarea button title noframes noembed xmp datalist".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = BLOCK - {"html", "body", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}
#: An element whose start ends open elements of the second set, up to the nearest of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}

# Quotes delimit a value behind "=" alone, elsewhere they are letters. Nothing that has matched is tried in another way.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=(?:\s*+(?:\"[^\"]*+\"|'[^']*+'))?+|[\"'])*+)>",
    re.S,
)
LETTER = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLANKS = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """A block-level element; ``runs`` are its own texts (order of the page, text, characters in links)."""

    __slots__ = ("tag", "attrs", "parent", "children", "runs", "depth", "tags", "images", "inputs", "links")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.runs: list[tuple[int, str, int]] = []
        self.depth = parent.depth + 1 if parent else 0
        self.tags = self.images = self.inputs = self.links = 0


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def clean(parts: list[str]) -> str:
    return BLANKS.sub(" ", html.unescape("".join(parts))).strip()


class Ends:
    """Where the elements of a page end, found once per element name."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">") + 1
        self.balanced: dict[str, dict[int, int]] = {}
        self.first: dict[str, list[tuple[int, int]]] = {}

    def raw(self, at: int, tag: str) -> int | None:
        """The place behind the first end tag from ``at`` on."""
        if tag not in self.first:
            found = re.compile(rf"</{tag}\s*[^>]*>", re.I).finditer(self.source, 0, self.last)
            self.first[tag] = [(m.start(), m.end()) for m in found]
        k = bisect_left(self.first[tag], (at, 0))
        return self.first[tag][k][1] if k < len(self.first[tag]) else None

    def matching(self, start: int, at: int, tag: str) -> int:
        """The place behind the end tag of the element whose start tag is at ``start``; ``at`` if it has none."""
        if tag not in self.balanced:
            ends: dict[int, int] = {}
            open_: list[int] = []
            for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(self.source, 0, self.last):
                if not m[1]:
                    open_.append(m.start())
                elif open_:
                    ends[open_.pop()] = m.end()
            self.balanced[tag] = ends
        return max(self.balanced[tag].get(start, at), at)


def parse(source: str) -> list[Node]:
    """All nodes in the order of their starts; the first is the page. Dropped and hidden elements leave nothing.

    A tag without an end, as a page that is cut off may have, is text up to the end of the page.
    """
    page = Node("#page", {}, None)
    nodes, stack = [page], [page]  # open block nodes
    opened: Counter[str] = Counter()  # of the open nodes, by name
    tails = Ends(source)
    parts: list[str] = []
    linked: list[str] = []
    state = {"order": 0, "link": 0}

    def flush() -> None:
        if parts:
            text = clean(parts)
            if text:
                stack[-1].runs.append((state["order"], text, min(len(text), len(clean(linked)))))
                state["order"] += 1
            parts.clear()
            linked.clear()

    def text(value: str) -> None:
        if value:
            parts.append(value)
            if state["link"]:
                linked.append(value)

    def close(until: int) -> None:
        flush()
        opened.subtract(n.tag for n in stack[until:])
        del stack[until:]
        state["link"] = 0

    at, size, scan = 0, len(source), TOKEN.match
    while at < size:
        begin = source.find("<", at)
        if begin < 0:
            text(source[at:])
            break
        m = scan(source, begin)
        if m is None and LETTER.match(source, begin):  # it was looked for up to the end of the page
            text(source[at:])
            break
        if m is None:
            text(source[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            text(source[at:begin])
        at = m.end()
        end, start = m[1], m[2]
        if start is not None:
            tag = start.lower()
            if tag in DROPPED:
                if tag in ("select", "textarea", "button"):
                    stack[-1].inputs += 1
                if not m[3].endswith("/"):
                    at = _behind(tails, begin, at, tag)
                parts.append(" ")
                continue
            if tag in BLOCK:
                flush()
                if tag in CLOSES_P:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == "p":
                            close(i)
                            break
                        if stack[i].tag not in ("p",):
                            break
                if tag in IMPLIED:
                    ends, within = IMPLIED[tag]
                    cut = None
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in within:
                            break
                        if stack[i].tag in ends or (cut is None and stack[i].tag == "p"):
                            cut = i
                        elif stack[i].tag != "p":
                            break
                    if cut is not None and any(n.tag in ends for n in stack[cut:]):
                        close(cut)
                attrs = attributes(m[3]) if m[3] else {}
                if tag == "hr":
                    continue
                if ("hidden" in attrs or HIDDEN.search(attrs.get("style", ""))) and tag not in ("html", "body"):
                    at = tails.matching(begin, at, tag)
                    continue
                if tag in ("html", "body") and opened[tag]:
                    continue
                stack[-1].tags += 1
                node = Node(tag, attrs, stack[-1])
                stack[-1].children.append(node)
                stack.append(node)
                opened[tag] += 1
                nodes.append(node)
                continue
            own = stack[-1]
            own.tags += 1
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                state["link"] = 1
                own.links += 1
            elif tag == "img":
                own.images += 1
            elif tag == "input":
                own.inputs += 1
            elif "hidden" in (m[3] or "") or "none" in (m[3] or ""):
                attrs = attributes(m[3])
                if tag not in VOID and ("hidden" in attrs or HIDDEN.search(attrs.get("style", ""))):
                    at = tails.matching(begin, at, tag)
        elif end is not None:
            tag = end.lower()
            if tag in BLOCK and not opened[tag]:
                flush()
            elif tag in BLOCK:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        if tag not in ("html", "body"):
                            close(i)
                        break
            elif tag == "a":
                state["link"] = 0
    flush()
    return nodes


def _behind(ends: Ends, start: int, at: int, tag: str) -> int:
    """The place behind an element without text; raw ones end at their first end tag, others are balanced."""
    if tag in RAW:
        found = ends.raw(at, tag)
        if found is None:
            return len(ends.source) if tag in ("script", "style", "textarea", "title") else at
        return found
    return ends.matching(start, at, tag)
