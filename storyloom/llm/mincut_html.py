"""Main text of web pages by minimum cuts.

A page is read into text blocks, which hang in its tree of elements. The graph has a node for each block and for each element that speaks
for or against what it holds. Terminal capacities are the costs of a linear classifier, in log-odds: a block's from its text alone (length,
link density, sentence ends, heading, likeness to the page's title), an element's from its kind and class names, once for each block that
hangs on it. Smoothness edges run from blocks to their element, from elements to the one around them, from blocks to the element that holds
several of them, and between neighbours, the stronger the nearer they are in the tree; an element that speaks against its content is tied
weakly to what is around it. The maximum flow's cut is the labelling of least total cost: text that reads like prose goes with the advert or
the comments that hold it, a bare link between paragraphs stays, a teaser among links goes, and an element's bad name yields to long prose.

Costs and edges are of one order, so no kind of evidence decides alone. Reading is linear in the page's length, whatever its depth.
Every page is a graph of its own, so pages are mapped where they are read; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import documents

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?:/?[a-zA-Z]|[!?/])[^>]*(?:>|\Z)",
    re.S | re.I,
)
#: One attribute: its name, and its value in double quotes, single quotes or none.
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMES = ("class", "id", "role", "itemprop")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: Elements whose content is no text of the page. One that is not closed ends at its tag, and so does a button or select around others of its
#: kind, which is not closed either, or around parts of a page.
_SKIPPED = {x: re.compile(rf"</{x}\s*>", re.I) for x in "noscript template svg textarea select title iframe canvas button".split()}
_INLINE_ONLY = ("button", "select")
_PART_START = re.compile(r"<(?:button|select|article|main|section|h1|h2|table)[\s/>]", re.I)
_AT_END = re.compile(r"\Z")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。！？](?=[\s\"'”’)]|$)")

#: A start tag of the first kind ends an open p.
_ENDS_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
#: Elements that a start tag of their own family ends, and the elements beyond which it does not look.
_FAMILY = {"p": "p", "li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td"}
_SCOPE = {"td": ("p",), "th": ("p",), "table": ("p", "tr", "td"), "ul": ("li",), "ol": ("li",), "dl": ("dd",), "tr": ("td",)}

#: What an element says for (positive) or against each block that hangs on it, in log-odds.
ELEMENT = {"nav": -7.5, "footer": -7.5, "aside": -7.5, "menu": -7.5, "dialog": -7.5, "header": -7.5, "form": -6.0, "fieldset": -4.0, "article": 1.0, "main": 1.0}
#: A bad name is a whole class name: one of the words, with a place before it and a part of a page after it at most (no tag-politics, has-sidebar).
_PART = r"(?:[_-](?:\d+|left|right|top|bottom|main|bar|box|body|content|text|list|links?|wrap|wrapper|container|inner|outer|area|section|block|unit|slot|menu|nav|notice|banner|icons?|buttons?|posts?|items?|form|signup|widgets?|overlay|consent))*"
BAD = re.compile(
    r"(?:(?:site|main|global|top|bottom|left|right|primary|secondary)[_-])?"
    r"(?:ads?|advert\w*|adbox|adslot|adsense|sponsor\w*|promo\w*|banner|popup|modal|overlay|cookies?|consent|gdpr|notice|alert|nav|navbar|navigation|menus?|breadcrumbs?|sidebar\w*|side|aside|rail|footer\w*|footnav|masthead|topbar|header|share|sharing|social|related|recommend\w*|trending|newsletter|subscribe|signup|login|search|searchbox|searchform|widgets?|toolbar|pagination|pager|tags?|copyright|disclaimer|complementary|contentinfo|toc|skip)"
    + _PART + r"|page[_-](?:footer|nav|navigation|menu|sidebar)|(?:post|entry|article|story)[_-](?:footer|share|sharing|tags|nav|navigation|related)",
    re.I,
)
COMMENTS = re.compile(r"(?:(?:post|entry|article|story|reader|user)[_-])?(?:comments?|commentlist|respond|replies|disqus|discussion)" + _PART, re.I)
GOOD = re.compile(r"(?:^|[_-])(?:article\w*|post|entry|story|content|main|body|text|articlebody)(?=$|[_-])", re.I)
BAD_NAME, COMMENT_NAME, GOOD_NAME, HIDDEN = -6.0, -8.5, 1.0, -100.0
#: Edges: from a block to an element that speaks against it or for it, to the one that holds several, and between siblings.
AGAINST, FOR, HOLDER, NEIGHBOUR = 8.0, 3.0, 1.5, 2.0
#: Characters of prose from which on an element holds as much as an article does.
ARTICLE = 1200
#: What is left of an edge that crosses into an element that speaks against its content.
CROSSING = 0.2


@dataclass(slots=True)
class Block:
    """A text, the element it hangs on, and what its own words say."""

    text: str
    element: int
    linked: int
    heading: str
    paragraph: bool


@dataclass(slots=True)
class Tree:
    """Elements by number: parent, depth, name, evidence by kind and by names.

    Number 0 is the page itself.
    """

    parent: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    name: list[str] = field(default_factory=lambda: [""])
    kind: list[float] = field(default_factory=lambda: [0.0])
    names: list[float] = field(default_factory=lambda: [0.0])
    title: str = ""

    def add(self, parent: int, name: str, attrs: str, article: bool) -> int:
        kind, names = evidence(name, attrs, article)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.name.append(name)
        self.kind.append(kind)
        self.names.append(names)
        return len(self.parent) - 1

    def steps(self, a: int, b: int) -> int:
        """How many steps lead from one element to another."""
        n = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a = self.parent[a]
            n += 1
        return n


def evidence(name: str, attrs: str, article: bool) -> tuple[float, float]:
    """What an element says by its kind, and by its names, which may be wrong."""
    kind, names = ELEMENT.get(name, 0.0), 0.0
    if name == "header" and article:
        kind = 0.0  # an article's own header holds its title
    if name == "form":
        kind, names = 0.0, kind  # some pages are one form
    if attrs:
        words = []
        for m in _ATTRIBUTE.finditer(attrs):
            attribute, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if attribute == "hidden" or attribute == "style" and _NOT_SHOWN.search(value) or attribute == "aria-hidden" and value.strip().lower() == "true":
                return HIDDEN, 0.0
            if attribute in _NAMES:
                words += value.split()
        if words and name not in ("body", "html"):
            if any(COMMENTS.fullmatch(w) for w in words):
                return min(kind, 0.0) + COMMENT_NAME, names
            if any(BAD.fullmatch(w) for w in words):
                return min(kind, 0.0), names + BAD_NAME
            if any(GOOD.search(w) for w in words):
                kind += GOOD_NAME
    return kind, names


@dataclass(slots=True)
class _Open:
    """An open element: its number in the tree, the stack's places of open p, li, dd, tr and td in scope, and what else is asked of it."""

    name: str
    element: int
    scope: dict[str, int]
    block: int
    heading: str
    paragraph: bool
    article: bool


def read(page: str) -> tuple[list[Block], Tree]:
    """The page's text blocks in order, and its tree of elements. The head's text is none of them."""
    out: list[Block] = []
    tree = Tree()
    root = _Open("", 0, {}, -1, "", False, False)
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}
    pieces: list[str] = []
    ends: dict[str, re.Match | None] = {}  # the next end tag of an element, and the next start of a part: each is looked for once
    part: re.Match | None = None
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if text and not places.get("head"):
                top = stack[-1] if stack else root
                out.append(Block(text, top.element, linked, top.heading, top.paragraph))
        linked = 0

    def shut(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().name].pop()

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if places.get("a"):
                linked += len(piece.strip())
        at = m.end()
        name = (m["raw"] or m["name"] or "").lower()
        if not name or m["raw"]:
            continue
        attrs = m["attrs"] or ""
        if name in _SKIPPED and not m["close"] and not attrs.endswith("/"):
            end = ends.get(name)
            if name not in ends or end is not None and end.start() < at:
                end = ends[name] = _SKIPPED[name].search(page, at)
            if end is not None and name in _INLINE_ONLY and (part is None or part.start() < at <= len(page)):
                part = _PART_START.search(page, at) or _AT_END.search(page, len(page))
            if end is not None and (name not in _INLINE_ONLY or part.start() >= end.start()):
                if name == "title" and not tree.title:
                    tree.title = _SPACE.sub(" ", html.unescape(page[at : end.start()])).strip().casefold()
                at = end.end()
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCKS or name == "head":
            flush()
        if m["close"]:
            k = places[name][-1] if places.get(name) else -1
            if k >= 0 and (name in BLOCKS or stack[-1].block <= k):  # an inline end tag closes nothing beyond its block
                shut(k)
            continue
        if name in VOID or name not in BLOCKS and attrs.endswith("/"):
            continue
        if name in BLOCKS and (k := places["head"][-1] if places.get("head") else -1) >= 0:
            shut(k)  # the head ends where the body's elements begin
        if name in _ENDS_P and stack and (k := stack[-1].scope.get("p", -1)) >= 0:
            shut(k)
        family = _FAMILY.get(name)
        if family and family != "p" and stack and (k := stack[-1].scope.get(family, -1)) >= 0:
            shut(k)
        above = stack[-1] if stack else root
        here = len(stack)
        scope = above.scope
        if name in _SCOPE and any(x in scope for x in _SCOPE[name]):
            scope = {x: k for x, k in scope.items() if x not in _SCOPE[name]}
        if family:
            scope = {**scope, family: here}
        block = name in BLOCKS
        stack.append(_Open(
            name, tree.add(above.element, name, attrs, above.article) if block else above.element, scope, here if block else above.block,
            name if name[0] == "h" and name[1:].isdigit() else above.heading, above.paragraph or name == "p", above.article or name in ("article", "main"),
        ))
        places.setdefault(name, []).append(here)
    pieces.append(page[at:])
    flush()
    return out, tree


def cost(block: Block, title: str = "") -> float:
    """What a block's own text says: positive for content, by so much."""
    n = len(block.text)
    value = min(3.0, n / 50) + min(2.5, max(0.0, (n - 300) / 400)) - 5.0 * min(1.0, block.linked / n)
    value += 0.75 * sum(1 for _ in islice(_SENTENCE.finditer(block.text), 2))
    if block.heading or block.paragraph:
        value += 0.5
    if block.heading and len(title) > 2 and (block.text.casefold() in title or title in block.text.casefold()):
        value += 2.5
    if "©" in block.text[:40]:
        value -= 3.0
    return value


def cut(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which of n nodes stay with the source in a minimum cut: by shortest augmenting levels, with explicit stacks."""
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        room.append(there)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for v in range(n):
        through = min(source[v], sink[v])
        if source[v] > through:
            add(s, v, source[v] - through, 0.0)
        if sink[v] > through:
            add(v, t, sink[v] - through, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in at[v]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        place = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                back = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                v = to[path[back] ^ 1]
                del path[back:]
                continue
            while place[v] < len(at[v]):
                e = at[v][place[v]]
                if room[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    path.append(e)
                    v = to[e]
                    break
                place[v] += 1
            else:
                if v == s:
                    break
                level[v] = -2  # leads nowhere in this phase
                v = to[path.pop() ^ 1]


_LEAVES = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6")


def name_weights(found: list[Block], tree: Tree) -> list[float]:
    """How much the bad name of each element counts, between 0 and 1.

    A name may be wrong, which shows where an element that has it holds nearly all of a page's prose. What it holds is set against the prose
    that no element speaks against: a sixth of it is enough for the name to count in full, and less where it holds less than an article, as
    notices and forms are short. Where there is no other prose at all the name does not count.
    """
    inside = [0.0] * len(tree.parent)
    against = [False] * len(tree.parent)
    for e in range(1, len(tree.parent)):  # inner elements have the larger numbers
        against[e] = tree.kind[e] < 0 or tree.names[e] < 0 or against[tree.parent[e]]
    outside = 0.0
    for b in found:
        size = len(b.text) if cost(b, tree.title) > 0 else 0
        inside[b.element] += size
        outside += size * (not against[b.element])
    for e in range(len(tree.parent) - 1, 0, -1):
        inside[tree.parent[e]] += inside[e]
    return [1.0 if held == 0 or names == 0 else min(1.0, 6 * outside / held * max(1.0, ARTICLE / held)) for held, names in zip(inside, tree.names)]


def label(found: list[Block], tree: Tree) -> list[bool]:
    """Which blocks are content."""
    n = len(found)
    total = [k + m * w for k, m, w in zip(tree.kind, tree.names, name_weights(found, tree))]
    zone = [0] * len(total)  # the nearest element with evidence, from each element on
    for e in range(1, len(total)):
        zone[e] = e if total[e] else zone[tree.parent[e]]
    zones = [zone[b.element] for b in found]
    node: dict[int, int] = {}
    hanging: dict[int, int] = {}
    for z in zones:
        while z and z not in node:  # the elements with evidence around a block
            node[z] = n + len(node)
            z = zone[tree.parent[z]]
    for z in zones:
        hanging[z] = hanging.get(z, 0) + 1
    edges: list[tuple[int, int, float]] = []
    costs = [cost(b, tree.title) for b in found] + [0.0] * len(node)
    for k, z in enumerate(zones):
        if z:
            edges.append((k, node[z], 1e6 if total[z] <= HIDDEN / 2 else AGAINST if total[z] < 0 else FOR))
    below = dict(hanging)
    for z in sorted(node, reverse=True):  # inner ones have the larger numbers
        m = below.get(z, 0)
        costs[node[z]] += total[z] * hanging.get(z, 0)
        outer = zone[tree.parent[z]]
        if outer:
            below[outer] = below.get(outer, 0) + (m if total[z] > 0 else 0)
            strong = total[outer] < 0 < total[z]
            if strong:
                costs[node[outer]] += total[outer] * m  # it speaks against these as well
            edges.append((node[z], node[outer], AGAINST * m if strong else HOLDER if total[z] > 0 else HOLDER * CROSSING))
    held: dict[int, list[int]] = {}
    for k, b in enumerate(found):
        held.setdefault(tree.parent[b.element] if tree.name[b.element] in _LEAVES else b.element, []).append(k)
        if k:
            a = found[k - 1]
            near = NEIGHBOUR / (1 + max(0, tree.steps(a.element, b.element) - 2))
            edges.append((k - 1, k, near if zones[k - 1] == zones[k] else near * CROSSING))
    size = n + len(node)
    for holder, members in held.items():
        if holder and len(members) > 1:
            around = zone[holder]
            edges += [(k, size, HOLDER if zones[k] == around else HOLDER * CROSSING) for k in members]
            costs.append(0.0)
            size += 1
    return cut(size, [max(0.0, c) for c in costs], [max(0.0, -c) for c in costs], edges)[:n]


def content(page: str | None) -> list[str]:
    """The page's content blocks in order."""
    found, tree = read(page or "")
    return [b.text for b, k in zip(found, label(found, tree)) if k]


def main_text(page: str | None) -> str:
    """The page's main text: content blocks joined by a blank line; empty for null, empty or textless pages."""
    return "\n\n".join(content(page))


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html and with text and n_chars (code points), which replace columns of those names.

    Null, empty and textless pages have an empty text. Repeated rows are read each, null ids and urls stay, no page is too long or too deep,
    and an empty table gives an empty result.
    """
    kept = pages.select(*(c for c in pages.columns if c not in ("text", "n_chars") or c == html_col))

    @F.pandas_udf("string")
    def extract(pages):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([main_text(x) for x in pages], dtype=object)

    return kept.withColumn("text", extract(F.col(html_col).cast("string"))).withColumn("n_chars", F.length("text").cast("long")).select(*(c for c in kept.columns if c != html_col), "text", "n_chars")


def op1_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(documents(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
