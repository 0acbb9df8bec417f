"""HTML extraction by minimum-cut labelling.

A page becomes blocks (text between block-level tags) with their path in the tree.  A logistic classifier
turns each block's features into a cost of calling it content or boilerplate: the capacities from the
source and to the sink.  Neighbouring blocks (page order) and blocks that follow one another under one
parent are joined by smoothness edges that weaken with their distance in the tree.  The minimum cut, found by
maximum flow, labels all blocks of a page at once.  Blocks whose own cost outweighs all their edges are
settled first, which leaves the cut the same and the flow small.

Words of classes, ids, roles and tag names hint at what a block is, with these limits: none count on html and body;
words of state ("has-sidebar", "menu-open") say nothing about an element; a word of place counts less than a word of content
beside it ("page-content-bottom"); classes, ids and forms around the page's main container (main, or its longest
article) say nothing about what is in it, but for those of comments.  Inline adverts leave the text of their block.

The classifier is trained here, on pages that a seeded generator writes with known labels; no page of
the input is used, so results do not depend on the rest of the table.

Defined results: null, empty and tagless-blank html give an empty text; html without tags is one block; unclosed
comments, scripts and tags run to the end of the page; repeated rows give equal results; other columns
pass through, one with the added name as <name>_in.  Work is linear in the page but for the flow, however deep the nesting.  Character references are decoded, white space (Unicode) inside a block becomes one space,
blocks are trimmed and joined by two newlines in page order.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter, deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caduspark.llm import shared

# Fixed values of HTML: block-level elements, elements without content, raw-text elements.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre section select summary "
    "table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template svg iframe".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}, "body": {"head"}}
ENDS_P = BLOCK - {"body", "html", "head", "button", "label", "option", "optgroup", "select", "textarea"}
# Words in tags, classes, ids and roles that speak for boilerplate or for content.
HINTS = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs topbar skip sitemap toc".split(),
    "header": "header masthead banner logo branding topnav".split(),
    "footer": "footer colophon copyright legal bottom credits imprint".split(),
    "aside": "aside sidebar side rail widget widgets complementary related recommended trending popular more tags tag cloud share social sharing follow author-box promo teaser".split(),
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted outbrain taboola".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay dialog newsletter subscribe subscription paywall message toast".split(),
    "form": "form search login signup register button select textarea fieldset label option input legend".split(),
    "comment": "comment comments commentlist respond reply replies disqus discussion thread feedback review reviews".split(),
    "content": "article main content post entry story body text prose articlebody maincontent".split(),
}
_HINT_OF: dict[str, list[str]] = {}
for _group, _words in HINTS.items():
    for _word in _words:
        _HINT_OF.setdefault(_word, []).append(_group)
GROUPS = list(HINTS)
#: Words that make a class name speak of a state, first or last in it, and words of place.
STATES = frozenset("no not has have with without is was hide hidden show shown open opened close closed active on off enabled disabled logged in out visible collapsed expanded".split())
PLACES = frozenset("bottom side top more header".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(4096)
def hints(attributes: str) -> frozenset[str]:
    """Groups that the classes, ids and roles of a tag hint at."""
    found = set()
    for match in _NAMES.finditer(attributes):
        for name in (match[1] or match[2] or match[3] or "").split():
            words = _PARTS.findall(_CAMEL.sub(" ", name).lower())
            if len(words) > 1 and (words[0] in STATES or words[-1] in STATES):
                continue
            if any("content" in _HINT_OF.get(w, ()) for w in words):
                words = [w for w in words if w not in PLACES]
            for word in words:
                found.update(_HINT_OF.get(word, ()))
    return frozenset(found)


_TAG_HINTS = {tag: frozenset(_HINT_OF.get(tag, ())) for tag in BLOCK} | {"html": frozenset(), "body": frozenset(), "noscript": frozenset(("notice",))}
_PARTS_PARAGRAPHS = frozenset(("td", "li", "div", "article", "section", "body", "blockquote"))


class Node:
    """An open or closed block-level element: named are the hints of its names, from where the text before it ended and after it."""

    __slots__ = ("tag", "parent", "depth", "named", "hints", "start", "end", "in_head", "paragraph")

    def __init__(self, tag: str, parent: Node | None, named: frozenset[str], start: int):
        self.tag, self.parent, self.named, self.start, self.end = tag, parent, named, start, -1
        self.depth = parent.depth + 1 if parent else 0
        self.hints: frozenset[str] | None = None
        self.in_head = tag == "head" or (parent is not None and parent.in_head)
        self.paragraph = self if tag == "p" else None if tag in _PARTS_PARAGRAPHS or parent is None else parent.paragraph  # the open p that a block would close


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, without scripts, styles, comments and the head."""
    out: list[Block] = []
    root = node = Node("", None, frozenset(), 0)
    root.hints = frozenset()
    nodes: list[Node] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = in_link = total = 0
    advert: list[str] = []  # inline tags open since an inline advert began

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and not node.in_head and node.tag != "title":
                out.append(Block(text, node, min(linked, len(text))))
                total += len(text)
            parts.clear()
        linked = 0
        advert.clear()

    def leave(top: Node) -> Node:
        """Close the open elements up to and with top."""
        up = node
        while True:
            up.end = total
            opened[up.tag] -= 1
            if up is top:
                return up.parent
            up = up.parent

    def nearest(tag: str) -> Node:
        up = node
        while up.tag != tag:
            up = up.parent
        return up

    at, n = 0, len(page)
    while at < n:
        less = page.find("<", at)
        if less < 0:
            less = n
        if less > at and not advert:
            parts.append(page[at:less])
            if in_link:
                linked += len(page[at:less].strip())
        if less >= n:
            break
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), less):
            end = page.find(">", less)
            at = n if end < 0 else end + 1
            continue
        match = _TAG.match(page, less)
        if not match:
            rest = page[less + 1 : less + 2]
            if (rest.isalpha() or rest == "/") and page.find(">", less) < 0 and page.find("<", less + 1) < 0:
                break  # a tag cut off by the end of the page
            if not advert:
                parts.append("<")
            at = less + 1
            continue
        close, tag, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        tag, at = tag.lower(), match.end()
        if tag in RAW:
            if not close and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in BLOCK:
            flush()
            in_link = 0
            if close:
                if opened[tag] > 0:
                    node = leave(nearest(tag))
            else:
                if tag in ENDS_P and node.paragraph:
                    node = leave(node.paragraph)
                if node.tag in CLOSES.get(tag, ()):
                    node = leave(node)
                if tag not in VOID and not (tag in ("html", "body") and opened[tag] > 0):
                    node = Node(tag, node, frozenset() if tag in ("html", "body") else hints(attributes), total)
                    opened[tag] += 1
                    nodes.append(node)
        elif tag == "br":
            parts.append(" ")
        elif advert:
            if tag in VOID:
                continue
            if not close:
                advert.append(tag)
            elif tag in advert:
                while advert.pop() != tag:
                    pass
        else:
            if tag == "a":
                in_link = 0 if close else 1
            if not close and tag not in VOID and attributes and "advert" in hints(attributes):
                advert.append(tag)
    flush()
    settle(nodes, total)
    return out


def settle(nodes: list[Node], total: int) -> None:
    """Hints of all nodes, parents first: their own and their parents', without those around the page's main container."""
    for node in nodes:
        if node.end < 0:
            node.end = total
    mains = [x for x in nodes if x.tag == "main"]
    mains = mains or [x for x in nodes if x.tag == "article" and "comment" not in x.named]
    kept = {"comment", "content"}
    if not mains:  # the longest element named after content: only a form around it is no form
        mains, kept = [x for x in nodes if x.named == {"content"}], set(GROUPS) - {"form"}
    around: set[int] = set()
    if mains:
        up = max(mains, key=lambda x: x.end - x.start).parent
        while up is not None:
            around.add(id(up))
            up = up.parent
    for node in nodes:
        named, tagged = node.named, _TAG_HINTS[node.tag]
        if id(node) in around:
            named &= kept
            tagged -= {"form"}
        node.hints = node.parent.hints | named | tagged


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_COPYRIGHT = re.compile("©|\\(c\\)|copyright|all rights reserved", re.I)
FEATURES = len(GROUPS) + 13


def features(block: Block, place: float) -> list[float]:
    text, node = block.text, block.node
    size = len(text)
    words = text.count(" ") + 1
    x = [1.0 if g in node.hints else 0.0 for g in GROUPS]
    content = "content" in node.hints
    bad = len(node.hints - {"content"}) > 0
    x += [
        1.0,
        min(size, 400) / 400,
        math.log1p(words) / 5,
        block.linked / size,
        1.0 if block.linked >= size else 0.0,
        1.0 if text[-1] in ".!?:;\"'”…" else 0.0,
        1.0 if node.tag in _HEADINGS and content and not bad else 0.0,
        1.0 if node.tag in ("p", "pre", "blockquote") else 0.0,
        1.0 if node.tag == "li" else 0.0,
        1.0 if _COPYRIGHT.search(text) and size < 300 else 0.0,
        1.0 if content and not bad else 0.0,
        1.0 if bad else 0.0,
        1.0 if place < 0.1 or place > 0.9 else 0.0,
    ]
    return x


FAR = 64


def distance(a: Node, b: Node) -> int:
    """Steps between two nodes of the tree, FAR at most."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges_of(blocks: list[Block], strength: float = 1.5) -> list[tuple[int, int, float]]:
    """Smoothness edges: adjacent blocks, and blocks that follow one another under one parent."""
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            same = blocks[i - 1].node.hints == block.node.hints
            edges.append((i - 1, i, strength * (1.0 if same else 0.25) / (1 + distance(blocks[i - 1].node, block.node) / 2)))
        parent = id(block.node.parent or block.node)
        if parent in last and last[parent] < i - 1:
            edges.append((last[parent], i, strength / 2))
        last[parent] = i
    return edges


def minimum_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels with the least sum of costs and cut edges; cost[i] > 0 favours True by as much.

    A block left undecided by the flow (the residual graph reaches it from neither terminal) is False.
    """
    n = len(cost)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    cost = list(cost)
    queue = deque(range(n))
    while queue:  # settle what its own cost decides, and fold it into its neighbours' costs
        i = queue.popleft()
        if label[i] is None and abs(cost[i]) > sum(near[i].values()):
            label[i] = cost[i] > 0
            for j, w in near[i].items():
                cost[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, value in zip(rest, _flow(rest, cost, near)):
            label[i] = value
    return [bool(x) for x in label]


def _flow(rest: list[int], cost: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Maximum flow by shortest augmenting paths; True on the source's side."""
    index = {v: i for i, v in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    cap: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
    for v, i in index.items():
        if cost[v] > 0:
            cap[source][i], cap[i][source] = cost[v], 0.0
        elif cost[v] < 0:
            cap[i][sink], cap[sink][i] = -cost[v], 0.0
        for j, w in near[v].items():
            cap[i][index[j]] = w
    while True:
        parent = {source: source}
        queue = deque([source])
        while queue and sink not in parent:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-9 and v not in parent:
                    parent[v] = u
                    queue.append(v)
        if sink not in parent:
            return [i in parent for i in range(len(rest))]
        flow, v = math.inf, sink
        while v != source:
            flow, v = min(flow, cap[parent[v]][v]), parent[v]
        v = sink
        while v != source:
            u = parent[v]
            cap[u][v] -= flow
            cap[v][u] = cap[v].get(u, 0.0) + flow
            v = u


def extract(page: str | None, weights: list[float]) -> str:
    """The main text of one page."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    total = sum(len(b.text) for b in blocks)
    cost, seen = [], 0
    for block in blocks:
        x = features(block, (seen + len(block.text) / 2) / total)
        seen += len(block.text)
        cost.append(max(-8.0, min(8.0, sum(a * b for a, b in zip(x, weights)))))
    return "\n\n".join(b.text for b, keep in zip(blocks, minimum_cut(cost, edges_of(blocks))) if keep)


def generate(rng: random.Random) -> list[tuple[str, bool | None]]:
    """One page as pieces of html: True content, False boilerplate, None neither (tags between them)."""
    word = lambda: "".join(rng.choice("aeiournstlm") for _ in range(rng.randint(2, 9)))
    sentence = lambda k: " ".join(word() for _ in range(k)).capitalize() + rng.choice("...!?")
    title = lambda: " ".join(word() for _ in range(rng.randint(2, 9))).capitalize() + rng.choice(["", "", "."])
    para = lambda: " ".join(sentence(rng.randint(1, 18)) for _ in range(rng.choice([1, 1, 2, 3, 5])))
    link = lambda: f'<a href="/{word()}">{title()}</a>'
    pieces: list[tuple[str, bool | None]] = [("<html><body>", None)]

    def box(group: str, tags: list[str], inner: list[tuple[str, bool | None]]) -> None:
        tag = rng.choice(tags)
        name = rng.choice(HINTS[group]) if tag in ("div", "section", "ul") or rng.random() < 0.3 else ""
        kind = rng.choice(("class", "id"))
        pieces.append((f'<{tag} {kind}="{name}">' if name else f"<{tag}>", None))
        pieces.extend(inner)
        pieces.append((f"</{tag}>", None))

    def boiler(group: str, tags: list[str]) -> None:
        inner: list[tuple[str, bool | None]] = []
        for _ in range(rng.randint(1, 6)):
            inner.append((rng.choice([f"<li>{link()}</li>", f"<p>{link()}</p>", f"<p>{para()}</p>", f"<div>{title()}</div>", f"<h3>{title()}</h3>"]), False))
        box(group, tags, inner)

    if rng.random() < 0.7:
        boiler("header", ["header", "div"])
    if rng.random() < 0.9:
        box("menu", ["nav", "div", "ul"], [(f"<li>{link()}</li>", False) for _ in range(rng.randint(2, 8))])
    if rng.random() < 0.4:
        boiler("notice", ["div", "section"])
    if rng.random() < 0.5:
        boiler("advert", ["div", "section"])
    if rng.random() < 0.3:
        boiler("aside", ["aside", "div"])
    inner: list[tuple[str, bool | None]] = []
    if rng.random() < 0.9:
        inner.append((f"<h1>{title()}</h1>", True))
    for _ in range(rng.randint(1, 9)):
        inner.append((rng.choice([f"<p>{para()}</p>"] * 5 + [f"<h2>{title()}</h2>", f"<blockquote>{para()}</blockquote>", f"<ul><li>{para()}</li></ul>", f"<p>{para()} {link()}, {para()}</p>", f"<p>{title()}</p>", f"<div>{para()}</div>"]), True))
    if rng.random() < 0.3:
        inner.insert(rng.randint(1, len(inner)), (f'<div class="{rng.choice(HINTS["advert"])}"><p>{para()}</p></div>', False))
    if rng.random() < 0.85:
        box("content", ["article", "main", "div", "section"], inner)
    else:
        pieces.append(("<div>", None))
        pieces.extend(inner)
        pieces.append(("</div>", None))
    if rng.random() < 0.4:
        boiler("comment", ["div", "section"])
    if rng.random() < 0.4:
        boiler("aside", ["aside", "div"])
    if rng.random() < 0.3:
        boiler("form", ["form"])
    if rng.random() < 0.9:
        box("footer", ["footer", "div"], [(f"<p>{rng.choice(['&copy; ', '', 'Copyright '])}{para()}</p>", False), (f"<p>{link()}</p>", False)])
    return pieces


@lru_cache(1)
def classifier(pages: int = 160, steps: int = 300, seed: int = 5) -> tuple[float, ...]:
    """Weights of the logistic classifier, fitted on generated pages."""
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        pieces = generate(rng)
        labels, marked = [], []
        for piece, label in pieces:
            if label is not None:
                labels.append(label)
            marked.append(piece)
        blocks = blocks_of("".join(marked))
        if len(blocks) != len(labels):
            continue
        total, seen = sum(len(b.text) for b in blocks), 0
        for block, label in zip(blocks, labels):
            x.append(features(block, (seen + len(block.text) / 2) / total))
            seen += len(block.text)
            y.append(label)
    a, b = np.array(x), np.array(y, float)
    w = np.zeros(a.shape[1])
    for _ in range(steps):  # Newton steps with a small ridge settle long before the last
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - b) + 0.5 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def extract_text(pages: DataFrame, html: str = "html", name: str = "main_text") -> DataFrame:
    """pages with the main text of column `html` in column `name`."""
    shared.tune(pages.sparkSession)
    weights = list(classifier())

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([extract(x.as_py(), weights) for x in column], pa.string())

    return shared.with_added(pages, name, run(F.col(f"`{html}`")))
