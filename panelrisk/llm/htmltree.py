"""A page as a tree of block nodes with features: the small per-page helper of the HTML extraction.

Only block-level elements are nodes; inline markup is part of its block's text.
Open paragraphs, list items and table cells end where the next one begins, end
tags without a start are ignored, and everything still open ends with the page,
so any byte soup gives a tree. A head without an end tag ends at the first text
or element that cannot be in a head. Every run of text that lies in no block
element is a paragraph of its own below the page, as browsers lay it out.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from dataclasses import dataclass, field

# fixed values: element names of HTML
BLOCKS = frozenset(
    """address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table
    tbody td tfoot th thead tr ul""".split()
)
SILENT = frozenset("head iframe noframes noscript object script style svg template title".split())
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())  # what a head may hold
RAW = frozenset("script style title textarea iframe noframes xmp".split())
CONTROLS = frozenset("button input label select textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SAME_ENDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
TAG_GROUPS = (
    {"article", "main"}, {"section"}, {"div"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"ul", "ol", "dl", "menu"},
    {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "dialog"}, {"table", "tbody", "tr", "td", "th"}, {"blockquote", "pre", "figure"},
)

# fixed values: attribute words by what they usually mark
WORDS = {
    "body": "article articlebody blog body content entry hentry main mainbody post prose story text",
    "menu": "breadcrumb breadcrumbs crumbs menu nav navbar navigation navi pager pagination tabs toc toolbar topbar",
    "head": "branding header head hero logo masthead sitehead top",
    "foot": "bottom colophon copyright credits foot footer legal siteinfo",
    "side": "aside complementary rail related recommended recommendations sidebar side teaser widget widgets more",
    "ad": "ad ads adsense advert advertisement advertising adverts banner promo promotion promoted sponsor sponsored sponsors taboola outbrain",
    "notice": "alert alertdialog announcement consent cookie cookies dialog disclaimer gdpr message modal notice notification overlay paywall popup privacy",
    "form": "contact form login newsletter register search signin signup subscribe subscription survey",
    "talk": "comment commentlist comments commenter discussion disqus feedback replies reply respond response responses review reviews thread",
    "share": "facebook follow like likes share sharing social tweet twitter",
}
GROUP_OF = {w: i for i, words in enumerate(WORDS.values()) for w in words.split()}
N_GROUPS = len(WORDS)

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_MARK = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    marks: int = 0  # bit per group of attribute words
    children: list[int] = field(default_factory=list)
    chars: int = 0  # of the subtree, as are the next ones
    linked: int = 0
    words: int = 0
    stops: int = 0
    blocks: int = 0
    nodes: int = 1
    paragraphs: int = 0
    controls: int = 0


def _marks(attributes: str) -> int:
    out = 0
    for a, b, c in _MARK.findall(attributes):
        for part in _PART.findall(a or b or c):
            group = GROUP_OF.get(part.lower())
            if group is not None:
                out |= 1 << group
    return out


def _hidden(attributes: str) -> bool:
    """Whether an attribute of that name hides the element; words inside other values say nothing."""
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(low):
        value = a or b or c
        if name == "hidden" or name == "style" and _NOT_SHOWN.search(value):
            return True
    return False


class _Open:
    """The open elements, with the places of those that the end of an element is looked for by.

    A place is found by name or by bisection, never by walking over what is
    open, so a page costs linear time however many elements it leaves open.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("html", 0)]  # an inline element points at its block; "!" marks a hidden one
        self.named: dict[str, list[int]] = {}  # places by name, hidden or not
        self.walls: list[int] = []  # blocks, hidden or not, but for paragraphs
        self.solid: list[int] = []  # blocks that are shown, but for paragraphs and headings
        self.paragraphs: list[int] = []

    def push(self, tag: str, node: int, hidden: bool = False) -> None:
        at = len(self.stack)
        self.stack.append((f"!{tag}" if hidden else tag, node))
        self.named.setdefault(tag, []).append(at)
        if tag in BLOCKS and tag != "p":
            self.walls.append(at)
        if tag in BLOCKS and not hidden:
            if tag == "p":
                self.paragraphs.append(at)
            elif tag not in HEADINGS:
                self.solid.append(at)

    def cut(self, depth: int) -> list[str]:
        """Take the elements from ``depth`` on off the stack; their names, ``!`` included."""
        gone = [tag for tag, _ in self.stack[depth:]]
        del self.stack[depth:]
        for tag in gone:
            self.named[tag.lstrip("!")].pop()
        for places in (self.walls, self.solid, self.paragraphs):
            while places and places[-1] >= depth:
                places.pop()
        return gone

    def ended_by(self, tag: str) -> int:
        """Place of the element that the end tag ``tag`` ends, 0 if there is none: an inline one ends no block."""
        places = self.named.get(tag)
        if not places or tag not in BLOCKS and self.walls and places[-1] < self.walls[-1]:
            return 0
        return places[-1]

    def ended_before(self, tag: str) -> list[int]:
        """Places to cut at before block ``tag`` begins: open paragraphs, then the item that it follows."""
        wall = self.solid[-1] if self.solid else 0
        first = bisect_right(self.paragraphs, wall)
        places = self.paragraphs[first : first + 1]
        name = self.stack[wall][0] if wall else ""
        if name and (name == tag and tag in SAME_ENDS or {name, tag} <= {"dt", "dd"} or {name, tag} <= {"td", "th"} or tag == "tr" and name in ("td", "th")):
            places.append(wall)
        return places


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes in page order, text blocks as (node, text) in page order). Node 0 is the page."""
    nodes = [Node("html", -1, 0)]
    blocks: list[tuple[int, str]] = []
    open_ = _Open()
    stack = open_.stack
    parts: list[str] = []
    linked = links = 0
    silent = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                at = stack[-1][1]
                if not at:  # in no block element
                    at = len(nodes)
                    nodes.append(Node("p", 0, 1, paragraphs=1))
                    nodes[0].children.append(at)
                blocks.append((at, text))
                node = nodes[at]
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.words += text.count(" ") + 1
                node.stops += sum(map(text.count, ".,;!?"))
                node.blocks += 1
        linked = 0

    def close(depth: int) -> None:
        """End all elements from ``depth`` of the stack on."""
        nonlocal links, silent
        if any(tag in BLOCKS for tag, _ in stack[depth:]):
            flush()
        for tag in open_.cut(depth):
            links -= tag == "a"
            silent -= tag in SILENT or tag.startswith("!")

    here = 0
    size = len(page)
    while here < size:
        token = _TOKEN.search(page, here)
        text = page[here : token.start() if token else size]
        if stack[-1][0] == "head" and text.strip():
            close(len(stack) - 1)
        if text and not silent:
            parts.append(text)
            if links:
                linked += len(text)
        if token is None:
            break
        here = token.end()
        ending, tag, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            at = open_.ended_by(tag)
            if at:
                close(at)
            continue
        if silent and (tag == "body" or stack[-1][0] == "head" and tag not in HEAD):
            if open_.named.get("head"):
                close(open_.named["head"][-1])
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            elif not silent:
                if tag == "br":
                    parts.append(" ")
                if tag in CONTROLS:
                    nodes[stack[-1][1]].controls += 1
            continue
        if tag in BLOCKS and not silent:
            # a paragraph ends at the next block, an item at the next item of its list
            for at in open_.ended_before(tag):
                close(at)
            flush()
            up = stack[-1][1]
            nodes.append(Node(tag, up, nodes[up].depth + 1, _marks(attributes) if attributes else 0))
            nodes[up].children.append(len(nodes) - 1)
            hidden = bool(attributes) and _hidden(attributes)
            open_.push(tag, len(nodes) - 1, hidden)
            silent += hidden
            nodes[-1].paragraphs += tag == "p"
            nodes[-1].controls += tag in CONTROLS
        else:
            if attributes.endswith("/") and tag in SILENT:
                continue
            open_.push(tag, stack[-1][1])
            links += tag == "a"
            silent += tag in SILENT
            if tag in CONTROLS:
                nodes[stack[-1][1]].controls += 1
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, here)
            if tag == "textarea" and not silent:
                parts.append(" ")
            here = end.start() if end else size
    close(1)
    flush()
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        node, up = nodes[i], nodes[nodes[i].parent]
        for name in ("chars", "linked", "words", "stops", "blocks", "nodes", "paragraphs", "controls"):
            setattr(up, name, getattr(up, name) + getattr(node, name))
    return nodes, blocks


FEATURES = [
    *(f"tag{i}" for i in range(len(TAG_GROUPS))), *(f"own_{w}" for w in WORDS), *(f"above_{w}" for w in WORDS), "tag_above_side",
    "own_other", "above_other", "own_body",
    "depth", "children", "log_chars", "link_share", "node_density", "words_per_block", "stop_share", "paragraphs", "controls",
    "page_share", "place", "siblings", "sibling_chars", "sibling_links", "parent_links", "parent_words_per_block", "same_tag_siblings",
]
_TAG_GROUP = {t: i for i, group in enumerate(TAG_GROUPS) for t in group}
_ASIDE_TAGS = {"nav", "header", "footer", "aside", "form", "fieldset", "dialog", "select"}


def features(nodes: list[Node]) -> tuple[list[int], list[list[float]]]:
    """(nodes with text, their features); the page node is left out."""
    total = max(1, nodes[0].chars)
    above = [0] * len(nodes)  # groups marked on the nodes above
    outside = [0.0] * len(nodes)  # whether an element above is one for other things than the article
    ids, rows = [], []
    order = [[c for c in n.children if nodes[c].chars] for n in nodes]
    place = {c: (k, len(cs)) for cs in order for k, c in enumerate(cs)}
    tags = [{} for _ in nodes]
    for i, cs in enumerate(order):
        for c in cs:
            tags[i][nodes[c].tag] = tags[i].get(nodes[c].tag, 0) + 1
    for i, node in enumerate(nodes):
        if i == 0:
            continue
        up = nodes[node.parent]
        above[i] = above[node.parent] | up.marks
        outside[i] = max(outside[node.parent], float(up.tag in _ASIDE_TAGS))
        if not node.chars:
            continue
        k, n = place[i]
        others = max(1, n - 1)
        row = [0.0] * len(TAG_GROUPS)
        group = _TAG_GROUP.get(node.tag)
        if group is not None:
            row[group] = 1.0
        row += [float(node.marks >> g & 1) for g in range(N_GROUPS)]
        row += [float(above[i] >> g & 1) for g in range(N_GROUPS)]
        row += [
            outside[i], float(node.tag in _ASIDE_TAGS or node.marks > 1), float(outside[i] or above[i] > 1), float(node.tag in TAG_GROUPS[0] or node.marks & 1),
            float(min(node.depth, 12)), float(min(len(node.children), 50)), math.log1p(node.chars), node.linked / node.chars,
            node.nodes / node.chars, min(200.0, node.words / max(1, node.blocks)), node.stops / node.chars, math.log1p(node.paragraphs), float(min(node.controls, 5)),
            node.chars / total, k / n, float(min(n, 50)), math.log1p((up.chars - node.chars) / others), (up.linked - node.linked) / max(1, up.chars - node.chars),
            up.linked / max(1, up.chars), min(200.0, up.words / max(1, up.blocks)), tags[node.parent][node.tag] / n,
        ]
        ids.append(i)
        rows.append(row)
    return ids, rows


def decode(nodes: list[Node], ids: list[int], odds: list[float], stay: float = 0.0) -> set[int]:
    """Nodes to keep: the best choice in which no node is kept below a dropped one.

    A node's value is its own log-odds plus what its children add; a node
    worth nothing falls with all below it. A text block without telling
    attributes gains ``stay`` from a kept element above it.
    """
    plain = {i for i in ids if nodes[i].parent > 0 and not nodes[i].children and not nodes[i].marks and nodes[nodes[i].parent].tag not in _ASIDE_TAGS}
    own = {i: v + stay * (i in plain) for i, v in zip(ids, odds)}
    value = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        value[i] = own.get(i, 0.0) + sum(max(0.0, value[c]) for c in nodes[i].children)
    kept = {0}
    for i in range(1, len(nodes)):
        if i in own and nodes[i].parent in kept and value[i] > 0:
            kept.add(i)
    return kept
