"""Small HTML trees, their text blocks, and simple tree matching between two of them."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

# Elements nested deeper are taken as part of their ancestor at this depth.
DEPTH = 150

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

# The elements of HTML by their part.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg object canvas".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul caption".split()
)
_DROPPED = frozenset("nav footer aside form button select option dialog menu input fieldset".split())
_REGION = frozenset(("article", "main"))
# A start tag of the key ends an open element of the values.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "body": ("head",),
}
# Names of classes and ids of what is not the article.
_NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion "
    "sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer footers "
    "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe signup login share sharing social related recommended "
    "widget widgets pagination pager toolbar copyright".split()
)
# What else may stand in such a name without making it another thing.
_NEUTRAL = frozenset(
    "area articles bar block bottom box buttons container content count div entry form group header head icon icons "
    "inner item items label left link links list main media more outer page panel post posts right row section "
    "site slot small stories text title top unit wrap wrapper".split()
)
_SITE_HEADER = frozenset(("header", "masthead", "topbar"))
# Parts of names that tell how an element is, not what it is.
_STATES = frozenset("has no not with without is open closed enabled disabled on off".split())
_DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split()
)


@dataclass
class Block:
    """A piece of text between block elements."""

    text: str
    dropped: bool
    region: bool
    linked: float
    holders: tuple[int, ...]
    # Dropped for a class or id only.
    named: bool = False
    # The tags of the elements that hold it.
    path: str = ""


@dataclass
class Page:
    """The blocks of a page and the tree they are the leaves of, as nested tuples."""

    blocks: list[Block] = field(default_factory=list)
    shape: tuple = ()


def parse(source: str | None) -> Page:
    """Never fails: broken markup is read as browsers do, roughly."""
    builder = _Builder()
    source, at = source or "", 0
    while at < len(source):
        token = _TOKEN.match(source, at)
        at = token.end()
        if token["text"] is not None:
            builder.text(token["text"])
        elif token["tag"] is not None:
            tag = token["tag"].lower()
            if token["end"]:
                builder.end(tag)
            elif tag in _RAW:
                close = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
                at = at if token["attributes"].endswith("/") else close.end() if close else len(source)
            else:
                builder.start(tag, token["attributes"])
    return builder.done()


class _Builder:
    def __init__(self) -> None:
        self.page = Page()
        self.pieces: list[str] = []
        self.linked = 0
        self.number = 0
        # tag, label, children, number, dropped (1 by name, 2 otherwise), region, link
        self.open: list[tuple] = [("", "", [], 0, 0, False, False)]
        # The same of elements below DEPTH, which are no nodes, and how many of each tag are open.
        self.deep: list[tuple] = []
        self.deep_tags: Counter[str] = Counter()

    def here(self) -> tuple:
        return self.deep[-1] if self.deep else self.open[-1]

    def text(self, raw: str) -> None:
        text = html.unescape(raw)
        self.pieces.append(text)
        if self.here()[6]:
            self.linked += len(text.strip())

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag in _BLOCK:
            self.flush()
            if self.has("p") and tag not in ("html", "body"):
                self.end("p")
        for ended in _ENDS.get(tag, ()):
            if self.within(ended, tag):
                self.end(ended)
        if tag in _VOID:
            return
        found = {
            m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(attributes)
        }
        above = self.here()
        names = f"{found.get('class', '')} {found.get('id', '')}"
        parts = set(names.lower().split())
        for name in names.split():
            # All of a name tells what an element is: "related-posts" is no article, "related-work" may be one.
            pieces = {n.lower() for n in _NAME.findall(name)}
            if not pieces & _STATES and pieces <= _NOT_ARTICLE | _SITE_HEADER | _NEUTRAL:
                parts |= pieces
        own = tag in _REGION or found.get("role") == "main" or found.get("itemprop") == "articleBody"
        region = above[5] or own
        hard = (
            above[4] == 2 or tag in _DROPPED or found.get("role") in _DROPPED_ROLES or "hidden" in found
            or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
            or not above[5] and tag == "header"
        )
        named = bool(parts & _NOT_ARTICLE) or not above[5] and bool(parts & _SITE_HEADER)
        named = above[4] == 1 or named and not own and tag not in ("html", "body")
        dropped = 2 if hard else int(named)
        if dropped != above[4]:
            self.flush()
        if len(self.open) > DEPTH:
            self.deep.append((tag, "", [], 0, dropped, region, above[6] or tag == "a"))
            self.deep_tags[tag] += 1
            return
        self.number += 1
        label = ".".join([tag, *sorted(names.lower().split())])
        self.open.append((tag, label, [], self.number, dropped, region, above[6] or tag == "a"))

    def has(self, tag: str) -> bool:
        return self.deep_tags[tag] > 0 or any(e[0] == tag for e in self.open)

    def within(self, tag: str, new: str) -> bool:
        """Whether the element is open in the innermost list or table."""
        for element in chain(reversed(self.deep), reversed(self.open)):
            if element[0] == tag:
                return True
            if element[0] in ("ul", "ol", "dl", "table", "menu", "select"):
                return False
        return False

    def end(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        if self.deep_tags[tag]:
            while True:
                element = self.deep[-1]
                if element[4] != (self.deep[-2] if len(self.deep) > 1 else self.open[-1])[4]:
                    self.flush()
                self.deep.pop()
                self.deep_tags[element[0]] -= 1
                if element[0] == tag:
                    return
        if not self.has(tag):
            return
        if self.deep:
            self.flush()
            self.deep.clear()
            self.deep_tags.clear()
        while True:
            element = self.open[-1]
            if element[4] != self.open[-2][4]:
                self.flush()
            self.open.pop()
            if element[0] in _BLOCK:
                self.open[-1][2].append((element[1], tuple(element[2])))
            else:
                self.open[-1][2].extend(element[2])
            if element[0] == tag:
                return

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            here = self.here()
            self.page.blocks.append(Block(
                text, here[4] > 0, here[5], min(1.0, self.linked / len(text)), tuple(e[3] for e in self.open), here[4] == 1,
                "/".join(e[0] for e in self.open),
            ))
            self.open[-1][2].append(("#", ()))
        self.pieces, self.linked = [], 0

    def done(self) -> Page:
        self.flush()
        while len(self.open) > 1:
            self.end(self.open[-1][0])
        self.page.shape = ("", tuple(self.open[0][2]))
        return self.page


def aligned(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Pairs of leaf numbers that simple tree matching puts on each other."""
    return list(_matched(a, b)[1])


@lru_cache(maxsize=8192)
def _leaves(node: tuple) -> int:
    return 1 if node[0] == "#" else sum(map(_leaves, node[1]))


@lru_cache(maxsize=8192)
def _matched(a: tuple, b: tuple) -> tuple[int, tuple]:
    """Most nodes that match with order and ancestry kept, and the leaves among them."""
    if a[0] != b[0]:
        return 0, ()
    if a == b:
        return _size(a), tuple((i, i) for i in range(_leaves(a)))
    left, right = a[1], b[1]
    # Equal subtrees at either end match each other in some best alignment.
    head = 0
    while head < min(len(left), len(right)) and left[head] == right[head]:
        head += 1
    tail = 0
    while tail < min(len(left), len(right)) - head and left[-1 - tail] == right[-1 - tail]:
        tail += 1
    pairs = [(i, i) for i in range(head)]
    middle = _middle(left[head : len(left) - tail], right[head : len(right) - tail])
    pairs += [(head + i, head + j) for i, j in middle]
    pairs += [(len(left) - t, len(right) - t) for t in range(tail, 0, -1)]
    a_starts, b_starts = _starts(left), _starts(right)
    score, leaves = 1, []
    for i, j in pairs:
        part, inside = _matched(left[i], right[j])
        score += part
        leaves += [(a_starts[i] + x, b_starts[j] + y) for x, y in inside]
    if a[0] == "#":
        leaves = [(0, 0)]
    return score, tuple(leaves)


@lru_cache(maxsize=8192)
def _size(node: tuple) -> int:
    return 1 + sum(map(_size, node[1]))


def _starts(children: tuple) -> list[int]:
    out, at = [], 0
    for child in children:
        out.append(at)
        at += _leaves(child)
    return out


def _middle(left: tuple, right: tuple) -> list[tuple[int, int]]:
    if not left or not right:
        return []
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, a in enumerate(left, 1):
        above, row = best[i - 1], best[i]
        for j, b in enumerate(right, 1):
            here = above[j - 1] + (_matched(a, b)[0] if a[0] == b[0] else 0)
            row[j] = max(above[j], row[j - 1], here)
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]
