"""Main text of web pages: boosted trees over DOM nodes, decoded over the tree.

Every block-level node gets features of its subtree (text density, links, tags, punctuation), its
attribute tokens and those above it, its depth, and its place among its siblings. Boosted trees score
three states of a node: within the article (KEEP), without any of it (DROP), and around it (SPLIT). The
decoding takes the best sum of scores in which a DROP node has only DROP nodes below it, a KEEP node no
SPLIT ones, and text is taken from KEEP nodes alone, so no ancestor contradicts a descendant.

The trees are fitted on a bounded sample of pages whose markup names the article, and on pages composed
of that sample's paragraphs and menus in other layouts, where the state of every node is known.
"""

from __future__ import annotations

import html
import math
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsluice.llm.common import per_block
from netsluice.llm.dom import Node, parse

#: Pages that the sample holds at most, those of least hash, and layouts composed from it.
SAMPLE_PAGES, COMPOSED_PAGES = 300, 1000
DROP, SPLIT, KEEP = 0, 1, 2

# Kinds of elements, and words of class, id and role names by what they tell.
KINDS = (
    ("article", "main"), ("section",), ("div", "center"), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6", "hgroup"),
    ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("table", "thead", "tbody", "tfoot", "tr"), ("td", "th", "caption"),
    ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "search"), ("figure", "figcaption"),
    ("blockquote", "pre"), ("html", "body", "#page"), ("dialog",),
)
HINTS = (
    r"article|story|post(?!er)|entry|blog|news(?!letter)", r"content|body|text|main|prose|copy(?!right)|inner|page",
    r"nav|menu|crumb|tabs?\b|pag(er|ination)|toc\b|skip", r"head(er)?\b|mast|banner|top|logo|brand",
    r"foot|copyright|legal|colophon|bottom", r"side|aside|rail|widget|column|panel",
    r"related|recommend|more|popular|trending|teaser|latest|also|next|prev", r"\bads?\b|advert|sponsor|promo|commercial|dfp|affiliate",
    r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|privacy|toast|warning|dialog", r"comment|disqus|repl(y|ies)|discuss|respon[ds]|reader|feedback|review",
    r"share|social|follow|twitter|facebook", r"form|subscri|newsletter|login|sign|search|contact|register",
    r"meta|byline|author|date|tags?\b|categor", r"title|headline|subject|summary|lead|intro", r"wrap|container|layout|grid|row|site|outer|app|root",
)
KIND_OF = {tag: k for k, tags in enumerate(KINDS) for tag in tags}
HINT = [re.compile(rf"(?:^|[^a-z])(?:{h})") for h in HINTS]
SENTENCE = re.compile(r"[.!?;:][\"')\]]?(?:\s|$)")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

_hints: dict[str, tuple[int, ...]] = {}


def hints(node: Node) -> tuple[int, ...]:
    """Which HINTS the attribute tokens of a node have."""
    a = node.attrs
    key = " ".join(a[k] for k in ("class", "id", "role", "itemprop", "aria-label") if k in a)
    if key not in _hints:
        if len(_hints) > 20_000:
            _hints.clear()
        names = CAMEL.sub(" ", key).lower().replace("_", "-")
        _hints[key] = tuple(k for k, h in enumerate(HINT) if h.search(names))
    return _hints[key]


#: Sums over a subtree: characters, characters in links, words, sentence ends, tags, links, images, inputs, blocks of text, long blocks.
SUMS = 10


def features(nodes: list[Node]) -> np.ndarray:
    """A row per node of ``parse``, in its order."""
    n, k = len(nodes), len(KINDS)
    index = {id(node): i for i, node in enumerate(nodes)}
    parent = np.array([index[id(node.parent)] if node.parent else -1 for node in nodes])
    sums, own = np.zeros((n, SUMS)), np.zeros(n)
    kind = np.zeros(n, int)
    tokens = np.zeros((n, len(HINTS)))
    first = np.zeros(n)
    for i, node in enumerate(nodes):
        kind[i] = KIND_OF.get(node.tag, 2)
        for h in hints(node) if node.attrs else ():
            tokens[i, h] = 1
        row = sums[i]
        for _, text, linked in node.runs:
            row[0] += len(text)
            row[1] += linked
            row[2] += text.count(" ") + 1
            row[3] += len(SENTENCE.findall(text))
            row[8] += 1
            row[9] += len(text) > 150
        own[i] = row[0]
        row[4], row[5], row[6], row[7] = node.tags, node.links, node.images, node.inputs
    hot = np.zeros((n, k))
    hot[np.arange(n), kind] = 1
    marks = np.concatenate([tokens, hot], axis=1)
    above = np.zeros((n, len(HINTS) + k))
    for i in range(1, n):
        above[i] = np.maximum(above[parent[i]], marks[parent[i]])
    below = tokens.copy()
    heading = (kind == 4).astype(float)
    for i in range(n - 1, 0, -1):
        sums[parent[i]] += sums[i]
        below[parent[i]] = np.maximum(below[parent[i]], below[i])
        heading[parent[i]] += heading[i]
    before = np.concatenate([[0], np.cumsum(own)[:-1]])
    total = max(1.0, sums[0, 0])
    first = before / total
    chars, linked, words = sums[:, 0], sums[:, 1], np.maximum(1, sums[:, 2])
    siblings, place, near = np.ones(n), np.zeros(n), np.zeros((n, 5))
    for i, node in enumerate(nodes):
        kids = [index[id(c)] for c in node.children]
        if kids:
            sizes, alike, m = chars[kids], kind[kids], len(kids)
            siblings[kids], place[kids] = m, np.arange(m) / m
            near[kids] = np.stack(
                [
                    (sizes.sum() - sizes) / max(1, m - 1), np.full(m, sizes.max()), np.append(-1, sizes[:-1]),
                    np.append(sizes[1:], -1), np.bincount(alike)[alike] / m,
                ],
                axis=1,
            )
    up = np.maximum(parent, 0)
    log = np.log1p
    rest = np.stack(
        [
            log(chars), linked / np.maximum(1, chars), sums[:, 3] / words, chars / words, log(sums[:, 4]), chars / (1 + sums[:, 4]),
            log(sums[:, 5]), log(sums[:, 6]), log(sums[:, 7]), log(sums[:, 8]), chars / np.maximum(1, sums[:, 8]),
            sums[:, 9], log(own), chars / total, chars / np.maximum(1, chars[up]), first, np.array([x.depth for x in nodes]),
            log(siblings), place, log(near[:, 0]), log(near[:, 1]), near[:, 2], near[:, 3], near[:, 4], heading, heading[up],
            log(chars[up]), linked[up] / np.maximum(1, chars[up]), kind[up].astype(float), np.full(n, log(total)),
        ],
        axis=1,
    )
    return np.concatenate([hot, tokens, above, below, rest], axis=1).astype(np.float32)


# ---------------------------------------------------------------- boosted trees


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: feature and threshold of each inner node, value of each leaf, per state."""

    start: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each state for each row."""
        out = np.tile(self.start, (len(x), 1))
        depth = self.feature.shape[2].bit_length()
        rows = np.arange(len(x))
        for s in range(self.feature.shape[0]):
            for t in range(self.feature.shape[1]):
                f, c = self.feature[s, t], self.cut[s, t]
                at = np.zeros(len(x), int)
                for _ in range(depth):
                    at = 2 * at + 1 + (x[rows, f[at]] > c[at])
                out[:, s] += self.leaf[s, t, at - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, penalty: float = 2.0) -> Trees:
    """Gradient boosting with second-order leaves over histogram bins, one logistic model per state."""
    used = np.flatnonzero(x.min(axis=0) < x.max(axis=0))
    cuts = [np.unique(np.append(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1]), x[:, j].min())) for j in used]
    cuts = [c[c < x[:, j].max()] for j, c in zip(used, cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in zip(used, cuts)], axis=1)
    inner, n, width = (1 << depth) - 1, len(x), len(used)
    feature, cut = np.zeros((3, trees, inner), np.int64), np.full((3, trees, inner), np.inf, np.float32)
    leaf, start = np.zeros((3, trees, inner + 1)), np.zeros(3)
    flat = binned + np.arange(width) * bins
    for s in range(3):
        target = (y == s).astype(float)
        rate_of = min(max(target.mean(), 1e-3), 1 - 1e-3)
        start[s] = math.log(rate_of / (1 - rate_of))
        score = np.full(n, start[s])
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = target - p, p * (1 - p)
            at = np.zeros(n, int)
            for level in range(depth):
                base = (1 << level) - 1
                for node in range(1 << level):
                    rows = np.flatnonzero(at == base + node)
                    place = base + node
                    if len(rows) >= 20:
                        cells = flat[rows].ravel()
                        sg = np.bincount(cells, np.repeat(g[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
                        sh = np.bincount(cells, np.repeat(h[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
                        gain = sg**2 / (sh + penalty) + (sg[:, -1:] - sg) ** 2 / (sh[:, -1:] - sh + penalty)
                        gain[:, -1] = -1
                        for j, c in enumerate(cuts):
                            gain[j, len(c) :] = -1
                        j, b = divmod(int(gain.argmax()), bins)
                        if gain[j, b] > sg[0, -1] ** 2 / (sh[0, -1] + penalty) + 1e-6:
                            feature[s, t, place], cut[s, t, place] = used[j], cuts[j][b]
                    at[rows] = 2 * place + 1 + (x[rows, feature[s, t, place]] > cut[s, t, place])
            value = np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + penalty) * rate
            leaf[s, t] = value
            score += value[at - inner]
    return Trees(start, feature, cut, leaf)


# ---------------------------------------------------------------- decoding


def decode(nodes: list[Node], scores: np.ndarray) -> np.ndarray:
    """The best states in which no node contradicts one above it."""
    n = len(nodes)
    index = {id(node): i for i, node in enumerate(nodes)}
    parent = [index[id(node.parent)] if node.parent else -1 for node in nodes]
    best = scores.astype(float).copy()
    for i in range(n - 1, 0, -1):
        drop, split, keep = best[i]
        up = best[parent[i]]
        up[DROP] += drop
        up[KEEP] += max(drop, keep)
        up[SPLIT] += max(drop, split, keep)
    state = np.zeros(n, int)
    state[0] = int(best[0].argmax())
    for i in range(1, n):
        above = state[parent[i]]
        if above == KEEP:
            state[i] = KEEP if best[i, KEEP] >= best[i, DROP] else DROP
        elif above == SPLIT:
            state[i] = int(best[i].argmax())
    return state


def kept_text(nodes: list[Node], state: np.ndarray) -> str:
    runs = sorted(r for node, s in zip(nodes, state) if s == KEEP for r in node.runs)
    return "\n".join(text for _, text, _ in runs)


# ---------------------------------------------------------------- training pages


def named_article(nodes: list[Node]) -> list[int] | None:
    """States of a page whose only <article>, or else only <main>, is its article; None for others."""
    for tag in ("article", "main"):
        found = [node for node in nodes if node.tag == tag]
        if len(found) == 1:
            break
    else:
        return None
    inside, around = {id(found[0])}, set()
    up = found[0].parent
    while up is not None:
        around.add(id(up))
        up = up.parent
    states = []
    for node in nodes:
        if node.parent is not None and id(node.parent) in inside and node.tag not in ("nav", "aside", "footer", "form", "dialog"):
            strong = {2, 5, 7, 8, 9, 10, 11}
            if not strong & set(hints(node)):
                inside.add(id(node))
        states.append(KEEP if id(node) in inside else SPLIT if id(node) in around else DROP)
    return states


class Composer:
    """Pages of known states, from paragraphs and menu words, in layouts drawn by a seeded generator."""

    def __init__(self, paragraphs: list[str], menus: list[str], seed: int = 7):
        self.r = random.Random(seed)
        syllables = "ba de ki lo mu na pe ri so ta vu wen".split()
        made = lambda n: " ".join("".join(self.r.choices(syllables, k=self.r.randint(1, 3))) for _ in range(n)).capitalize() + "."
        self.paragraphs = paragraphs or [" ".join(made(self.r.randint(4, 14)) for _ in range(self.r.randint(1, 6))) for _ in range(300)]
        self.menus = menus or [made(self.r.randint(1, 3)).rstrip(".") for _ in range(200)]

    def _of(self, *choices: str) -> str:
        return self.r.choice(choices)

    def _name(self, *names: str) -> str:
        """An attribute of one of the names, or none at all."""
        x = self.r.random()
        name = self._of(*names)
        extra = self._of("", "", " clearfix", " col-8", " js-x", " box", " mt-4", " inner")
        return "" if x < 0.12 else f' id="{name}"' if x < 0.35 else f' class="{name}{extra}"'

    def _el(self, tag: str, state: int, inner: str, attrs: str = "") -> str:
        return f'<{tag} data-state="{state}"{attrs}>{inner}</{tag}>'

    def _sentence(self, most: int = 90) -> str:
        p = self.r.choice(self.paragraphs)
        return html.escape(p[: p.find(" ", self.r.randint(15, most)) or most].strip() or p[:most])

    def _heading(self, most: int) -> str:
        """A sentence, or a few of its words."""
        text = self._sentence(most)
        return " ".join(text.split(" ")[: self.r.randint(1, 4)]) if self.r.random() < 0.35 else text

    def _links(self, n: int) -> str:
        return "".join(self._el("li", DROP, f'<a href="/{k}">{html.escape(self.r.choice(self.menus))}</a>') for k in range(n))

    def _menu(self) -> str:
        return self._el(self._of("ul", "ul", "ol"), DROP, self._links(self.r.randint(2, 9)), self._name("menu", "links", "nav-list", "list"))

    def _paragraph(self) -> str:
        return html.escape(self.r.choice(self.paragraphs))

    def _boiler(self) -> str:
        """One menu, header, sidebar, notice, advert, form, share bar or comment section."""
        r, el, d = self.r, self._el, DROP
        kind = r.randint(0, 9)
        if kind == 0:
            return el(self._of("nav", "nav", "div"), d, self._menu(), self._name("nav", "navbar", "main-menu", "breadcrumb", "menu"))
        if kind == 1:
            inner = el(self._of("div", "p", "h1", "h2"), d, html.escape(r.choice(self.menus)), self._name("logo", "brand", "site-title"))
            return el(self._of("header", "div"), d, inner + (self._menu() if r.random() < 0.6 else ""), self._name("header", "masthead", "top-bar", "site-header", "banner"))
        if kind == 2:
            parts = [
                el("h3", d, html.escape(r.choice(self.menus))) + (self._menu() if r.random() < 0.6 else el("p", d, self._sentence(160)))
                for _ in range(r.randint(1, 4))
            ]
            return el(self._of("aside", "div", "section"), d, "".join(el("div", d, p, self._name("widget", "box", "module", "panel")) for p in parts), self._name("sidebar", "side", "right-rail", "aside", "secondary"))
        if kind == 3:
            inner = el("p", d, self._of("We use cookies to improve this site. ", "", "This site uses cookies. ") + self._sentence(120))
            return el(self._of("div", "section", "aside", "dialog"), d, inner + (f"<button>{r.choice(self.menus)}</button>" if r.random() < 0.6 else ""), self._name("cookie-banner", "notice", "consent", "alert", "gdpr", "popup", "modal", "notification"))
        if kind in (4, 5):
            inner = self._sentence(150) if r.random() < 0.5 else el(self._of("p", "div", "span"), d, f'<a href="#">{self._sentence(120)}</a>')
            return el(self._of("div", "div", "aside", "section"), d, inner, self._name("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot"))
        if kind == 6:
            inner = el("label", d, html.escape(r.choice(self.menus))) + "<input type='text'><input type='submit'>"
            lead = el("p", d, self._sentence(100)) if r.random() < 0.6 else ""
            return el("form", d, lead + inner) if r.random() < 0.5 else el("div", d, lead + el("form", d, inner), self._name("newsletter", "subscribe", "login", "search", "signup"))
        if kind == 7:
            posts = "".join(
                el(self._of("div", "li", "article"), d, el(self._of("p", "div", "h4"), d, html.escape(r.choice(self.menus)), self._name("author", "user", "meta")) + "".join(el("p", d, self._paragraph()[: r.randint(40, 600)]) for _ in range(r.randint(1, 2))), self._name("comment", "reply", "comment-body", "response"))
                for _ in range(r.randint(1, 6))
            )
            title = el(self._of("h2", "h3"), d, f"{r.randint(1, 40)} comments") if r.random() < 0.6 else ""
            return el(self._of("section", "div", "ol"), d, title + posts, self._name("comments", "comment-list", "discussion", "responses", "reader-comments"))
        if kind == 8:
            cards = "".join(el(self._of("div", "li"), d, el("h3", d, f'<a href="#">{self._sentence(70)}</a>') + (el("p", d, self._sentence(110)) if r.random() < 0.5 else "")) for _ in range(r.randint(2, 6)))
            return el(self._of("section", "div", "aside"), d, el("h2", d, html.escape(r.choice(self.menus))) + cards, self._name("related", "recommended", "more-stories", "popular", "read-next"))
        return el("div", d, "".join(f'<a href="#">{html.escape(r.choice(self.menus))}</a> ' for _ in range(r.randint(2, 5))), self._name("share", "social", "tags", "follow"))

    def _footer(self) -> str:
        r, el = self.r, self._el
        text = self._of("&copy; ", "&copy; 2023 ", "Copyright ", "") + html.escape(r.choice(self.menus)) + self._of("", " All rights reserved.", " &middot; " + self._sentence(60))
        inner = text if r.random() < 0.5 else el("p", DROP, text) + (self._menu() if r.random() < 0.5 else "")
        return el(self._of("footer", "footer", "div"), DROP, inner, self._name("footer", "site-footer", "colophon", "bottom", "copyright"))

    def _article(self) -> list[str]:
        r, el, out = self.r, self._el, []
        if r.random() < 0.85:
            title = el(self._of("h1", "h1", "h1", "h2"), KEEP, self._heading(80))
            out.append(el(self._of("header", "div"), KEEP, title, self._name("article-header", "entry-header", "title")) if r.random() < 0.2 else title)
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            x = r.random()
            if x < 0.76:
                text = self._paragraph()
                if r.random() < 0.2 and " " in text:
                    a, _, b = text.partition(" ")
                    text = f'{a} <a href="/x">{b[:30]}</a>{b[30:]}' if "&" not in b[:34] else text
                if r.random() < 0.1:
                    text = f"<b>{text}<br>"
                out.append(el("div" if r.random() < 0.08 else "p", KEEP, text))
            elif x < 0.82:
                out.append(el(self._of("h2", "h3"), KEEP, self._heading(60)))
            elif x < 0.87:
                out.append(el(self._of("ul", "ol"), KEEP, "".join(el("li", KEEP, self._sentence(120)) for _ in range(r.randint(2, 6)))))
            elif x < 0.91:
                out.append(el("blockquote", KEEP, el("p", KEEP, self._paragraph()) if r.random() < 0.6 else self._paragraph()))
            elif x < 0.94:
                cells = lambda: "".join(el("td", KEEP, self._sentence(30)) for _ in range(3))
                out.append(el("table", KEEP, "".join(el("tr", KEEP, cells()) for _ in range(r.randint(2, 4)))))
            elif x < 0.96:
                out.append(el("figure", KEEP, '<img src="x.png">' + el("figcaption", KEEP, self._sentence(80))))
            else:
                out.append(el("pre", KEEP, self._sentence(120)))
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            out.insert(r.randint(min(1, len(out)), len(out)), self._boiler())
        return out

    def page(self) -> str:
        r, el = self.r, self._el
        if r.random() < 0.05:  # nothing but a few words
            words = [self._sentence(60) for _ in range(r.randint(1, 3))]
            inner = words[0] if r.random() < 0.3 else "".join(el(self._of("p", "p", "div"), KEEP, w) for w in words)
            return f'<html data-state="{KEEP}"><body data-state="{KEEP}">{inner}</body></html>'
        article = self._article()
        tag = self._of("article", "article", "main", "div", "div", "div", "section", "td")
        name = self._name("content", "post-content", "entry-content", "article-body", "story", "main-content", "text", "post", "prose", "page-body")
        if r.random() < 0.08:
            tag = None  # the article's blocks stand among the others
        if tag == "td":
            body = el("table", SPLIT, el("tr", SPLIT, (el("td", DROP, self._menu()) if r.random() < 0.6 else "") + el("td", KEEP, "".join(article), name)))
        elif tag:
            if r.random() < 0.25 and len(article) > 1:
                article = [article[0], el("div", KEEP, "".join(article[1:]), self._name("body", "content", "entry", "text"))]
            body = el(tag, KEEP, "".join(article), name)
        else:
            body = "".join(article)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            if not tag:
                break
            beside = [self._boiler() for _ in range(r.choice([0, 1, 1]))]
            at = r.randint(0, len(beside))
            parts = beside[:at] + [body] + beside[at:]
            body = el(self._of("div", "main", "section", "div"), SPLIT, "".join(parts), self._name("wrapper", "container", "main", "page", "layout", "content"))
        before = [self._boiler() for _ in range(r.choice([0, 1, 2, 3]))]
        after = [self._boiler() for _ in range(r.choice([0, 0, 1, 2]))] + ([self._footer()] if r.random() < 0.8 else [])
        state = SPLIT if tag else KEEP
        head = f"<head><title>{self._sentence(60)}</title><style>p{{}}</style></head>"
        return f'<!DOCTYPE html><html data-state="{state}">{head}<body data-state="{state}">{"".join(before)}{body}{"".join(after)}</body></html>'


def known_states(nodes: list[Node]) -> list[int]:
    """States that a composed page names; the page itself has that of its first element."""
    states = [int(node.attrs.pop("data-state", node.parent and -1 or SPLIT)) for node in nodes]
    for i, node in enumerate(nodes):
        if states[i] < 0:
            states[i] = DROP
    if len(states) > 1:
        states[0] = states[1]
    return states


def fit_on(pages: list[str], composed: int = COMPOSED_PAGES, seed: int = 7) -> Trees:
    """Fit on those pages that name their article, and on as many composed ones as asked for."""
    x, y, paragraphs, menus = [], [], [], []
    for source in pages:
        nodes = parse(source)
        states = named_article(nodes)
        if states is None:
            continue
        x.append(features(nodes))
        y += states
        for node, state in zip(nodes, states):
            (paragraphs if state == KEEP else menus).extend(t for _, t, _ in node.runs if len(t) < 1500)
    menus = [m[:40] for m in menus if m]
    composer = Composer(sorted(set(p for p in paragraphs if len(p) > 20)), sorted(set(menus)), seed)
    for _ in range(composed):
        nodes = parse(composer.page())
        y += known_states(nodes)
        x.append(features(nodes))
    return fit(np.concatenate(x), np.array(y))


def train(df: DataFrame, sample_pages: int = SAMPLE_PAGES, composed: int = COMPOSED_PAGES, id_col: str = "page_id", html_col: str = "html") -> Trees:
    """Fit on at most ``sample_pages`` pages, those of least hash; the driver holds these alone."""
    rows = (
        df.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
        .dropna().filter(F.length("html").between(1, 200_000))
        .orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(sample_pages)
    )
    return fit_on([r["html"] for r in rows.collect()], composed)


def extract(sources: list[str], trees: Trees) -> list[str]:
    parsed = [parse(s) for s in sources]
    scores = trees.scores(np.concatenate([features(nodes) for nodes in parsed])) if parsed else np.zeros((0, 3))
    out, at = [], 0
    for nodes in parsed:
        out.append(kept_text(nodes, decode(nodes, scores[at : at + len(nodes)])))
        at += len(nodes)
    return out


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extracted(df: DataFrame, trees: Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row; a null or empty page, or one without an article, has an empty text."""
    rows = df.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )

    def run(batch, sources):
        texts = extract(sources, trees)
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return rows.mapInArrow(per_block(run, EXTRACTED, "html"), "page_id long, url string, text string, n_chars long")
