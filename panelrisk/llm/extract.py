"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Every block node gets features (element kind, attribute words of its own and
above, depth, density of markup and links in its subtree, words per block,
share of the page, sibling statistics). A gradient-boosted forest gives its
log-odds of being article text or holding some; the decoder then picks the
best set of nodes in which none is kept below a dropped one.

Training pages are made, not given: about ``FIT_PAGES`` pages are drawn by a
hash of the id (the documented bound of the training sample). Where a page
marks its article by an element of that name, the marks are labels; and the
prose of the drawn pages is set into ``FIT_SKINS`` page skins with menus, headers,
sidebars, notices, adverts, forms and reader comments of known kind, some of
them inside the article and some without any telling attribute; some articles
and rows of links stand in no block element at all. The forest
(``TREES`` trees of depth ``DEPTH``) has a fixed size; pages are scored where
they lie and never move.

Cases: a null or empty html, and a page without article text, give an empty
text; broken markup is read as browsers do in spirit (see ``htmltree``); very
long pages are read whole; repeated rows get equal answers; an empty table
gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm import htmltree
from panelrisk.session import cut_lineage

FIT_PAGES, FIT_SKINS, TREES, DEPTH, STEP = 200, 800, 20, 4, 0.4
STAY = 1.0  # log-odds that an unmarked text block gains from a kept element above it
_MARK = ""  # stands in the text of article blocks of training pages

# fixed values: what surrounds an article, as (elements, attribute words)
_KINDS = {
    "menu": (["nav", "div", "ul", "div"], ["", "menu", "main-nav", "navbar", "breadcrumb", "site-navigation"]),
    "head": (["header", "div"], ["", "header", "site-header", "masthead", "branding"]),
    "foot": (["footer", "div"], ["", "footer", "site-footer", "colophon"]),
    "side": (["aside", "div"], ["", "sidebar", "widget", "related", "right-rail", "more-stories"]),
    "ad": (["div", "section", "aside"], ["ad", "ads", "advert", "sponsored", "banner-ad", "promo", "ad-slot"]),
    "notice": (["div", "section", "p"], ["cookie-notice", "gdpr-consent", "alert", "notice", "cookie-banner", "popup", "modal"]),
    "form": (["form", "div"], ["", "newsletter-signup", "subscribe", "login-form", "search-box"]),
    "talk": (["div", "section", "ul"], ["comments", "comment-list", "discussion", "disqus-thread", "replies", "user-reviews"]),
    "share": (["div", "ul", "p"], ["share", "social-links", "share-buttons"]),
}
_ARTICLES = [("article", ""), ("article", "post"), ("main", ""), ("div", "post-content"), ("div", "content"), ("section", "entry"), ("div", "story-body"), ("div", "x7"), ("td", ""), ("div", ""),
    # also under words that elsewhere mark surroundings
    ("article", "review"), ("div", "content top"), ("div", "post more-text"), ("main", "main header-image"), ("section", "story review")]


def _attribute(rng: random.Random, words: str) -> str:
    return f' {rng.choice(["class", "id", "class"])}="{words}"' if words else ""


def _filler(rng: random.Random, prose: list[str]) -> str:
    return rng.choice(prose)


def _short(rng: random.Random, prose: list[str], most: int = 4) -> str:
    words = rng.choice(prose).split()
    at = rng.randrange(len(words))
    return " ".join(words[at : at + rng.randint(1, most)])


def _surround(rng: random.Random, kind: str, prose: list[str]) -> str:
    """A block of one of the kinds that are not article text."""
    elements, words = _KINDS[kind]
    tag, marks = rng.choice(elements), rng.choice(words)
    bare = kind in ("menu", "share") and rng.random() < 0.25  # told by its links alone
    if bare:
        tag, marks = rng.choice(["div", "ul"]), ""
    elif not marks and tag in ("div", "section", "ul", "p"):
        marks = rng.choice([w for w in words if w])
    links = lambda n: [f'<a href="/{i}">{_short(rng, prose)}</a>' for i in range(n)]
    if kind in ("menu", "share") or kind in ("side", "foot", "head") and rng.random() < 0.4:
        items = links(rng.randint(2, 9))
        if tag == "ul":
            inner = "".join(f"<li>{x}</li>" for x in items)
        elif rng.random() < 0.6:
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        else:
            inner = " ".join(items)
        if kind == "side":
            inner = f"<h3>{_short(rng, prose)}</h3>" + inner
    elif kind == "talk":
        one = "li" if tag == "ul" else "div"
        inner = "" if tag == "ul" else f"<h3>{_short(rng, prose)}</h3>"
        for _ in range(rng.randint(1, 6)):
            said = "".join(f"<p>{_filler(rng, prose)}</p>" for _ in range(rng.randint(1, 3)))
            inner += f'<{one}{_attribute(rng, rng.choice(["comment", "reply", "", ""]))}><p>{_short(rng, prose)}</p>{said}</{one}>'
    elif kind == "form":
        inner = f"<p>{_short(rng, prose, 12)}</p><label>{_short(rng, prose)}</label><input name=q><button>{_short(rng, prose, 2)}</button>"
    else:
        text = _filler(rng, prose) if rng.random() < 0.6 else _short(rng, prose, 12)
        inner = text if tag == "p" or rng.random() < 0.5 else "".join(f"<p>{t}</p>" for t in [text, *([_filler(rng, prose)] if rng.random() < 0.4 else [])])
        if kind == "foot":
            inner = "&copy; " + inner
        if kind in ("head", "side") and tag != "p":
            inner = f"<h{rng.randint(1, 4)}>{_short(rng, prose)}</h{3}>" + inner
    return f"<{tag}{_attribute(rng, marks)}>{inner}</{tag}>"


def _article(rng: random.Random, prose: list[str], inside: list[str]) -> str:
    """An article whose blocks carry the mark, with the surroundings ``inside`` set between them."""
    parts = [f"<h1>{_MARK}{_short(rng, prose, 10)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 10)):
        kind, text = rng.random(), _filler(rng, prose)
        if kind < 0.7:
            if rng.random() < 0.2:
                words = text.split()
                words[len(words) // 2] = f'<a href="/x">{words[len(words) // 2]}</a>'
                text = " ".join(words)
            parts.append(f"<p>{_MARK}{text}</p>")
        elif kind < 0.78:
            parts.append(f"<h2>{_MARK}{_short(rng, prose, 6)}</h2>")
        elif kind < 0.86:
            parts.append("<ul>" + "".join(f"<li>{_MARK}{_short(rng, prose, 14)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
        elif kind < 0.9:
            parts.append(f"<blockquote><p>{_MARK}{text}</p></blockquote>")
        elif kind < 0.94:
            parts.append(f"<pre>{_MARK}{text}</pre>")
        elif kind < 0.97:
            parts.append("<table>" + "".join(f"<tr><td>{_MARK}{_short(rng, prose)}</td><td>{_MARK}{_short(rng, prose)}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>")
        else:
            parts.append(f"<p>{_MARK}{_short(rng, prose, 3)}</p>")
    for x in inside:
        parts.insert(rng.randint(0, len(parts)), x)
    tag, marks = rng.choice(_ARTICLES)
    body = f"<{tag}{_attribute(rng, marks)}>" + "".join(parts) + f"</{tag}>"
    if tag == "td":
        body = f"<table><tr>{body}</tr></table>"
    for _ in range(rng.randint(0, 2)):
        body = f'<div{_attribute(rng, rng.choice(["", "wrapper", "container", "page", "main", "row"]))}>{body}</div>'
    return body


def skin(rng: random.Random, prose: list[str]) -> str:
    """A training page: an article, or now and then none, amid surroundings of known kind."""
    around = lambda kinds, odds: [_surround(rng, k, prose) for k in kinds if rng.random() < odds]
    inside = around(["ad", "share", "form", "notice", "side", "talk"], 0.12)
    article = _article(rng, prose, inside) if rng.random() < 0.9 else ""
    before = around(["notice", "head", "menu", "ad", "menu"], 0.5) or [_surround(rng, "menu", prose)]
    after = around(["ad", "share", "side", "form", "talk", "talk", "side", "menu", "notice"], 0.35) + around(["foot"], 0.8)
    if article and rng.random() < 0.1:  # text in no block element
        article = "<br><br>".join(_MARK + _filler(rng, prose) for _ in range(rng.randint(1, 8)))
    if rng.random() < 0.15:  # links in none
        (before if rng.random() < 0.5 else after).insert(0, "<hr>" + " ".join(f'<a href="/{i}">{_short(rng, prose)}</a>' for i in range(rng.randint(3, 9))) + "<hr>")
    return "<body>" + "".join([*before, article, *after]) + "</body>"


def _labelled(page: str, marked: bool) -> list[tuple[float, list[float]]]:
    """(label, features) of the nodes of a training page."""
    nodes, blocks = htmltree.parse(page)
    good = [False] * len(nodes)
    if marked:
        texts = {i for i, t in blocks if _MARK in t}
    else:
        held = [False] * len(nodes)
        for i, n in enumerate(nodes):
            up = n.parent >= 0 and held[n.parent]
            held[i] = (up or n.tag == "article") and n.tag not in ("nav", "aside", "form", "footer")
        if not any(held):
            return []
        texts = {i for i, _ in blocks if held[i]}
    for i in texts:
        while i >= 0 and not good[i]:
            good[i] = True
            i = nodes[i].parent
    ids, rows = htmltree.features(nodes)
    return [(float(good[i]), row) for i, row in zip(ids, rows)]


def _training_rows(skins: int):
    return lambda batches: _label_batches(batches, skins)


def _label_batches(batches: Iterator[pa.RecordBatch], skins: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, rows = [], []
        for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rng = random.Random(f"skin {page_id}")
            _, blocks = htmltree.parse(page or "")
            prose = [re.sub(r"[<>&]", " ", t) for _, t in blocks if t.count(" ") >= 4]
            prose = [t for t in prose if t.split()] or ["A plain sentence, and then some words more.", "Another one that says little."]
            found = _labelled(page or "", marked=False)
            for _ in range(skins):
                found += _labelled(skin(rng, prose), marked=True)
            labels += [x for x, _ in found]
            rows += [x for _, x in found]
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.float64()), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])


def _trees(debug: str, weights: list[float]) -> list[tuple[np.ndarray, ...]]:
    """Arrays (feature, threshold, left, right, value) of every tree, from the model's printed rules."""
    out = []
    for number, body in enumerate(re.split(r"\n\s*Tree \d+ \(weight [^)]*\):\n", debug)[1:]):
        feature, threshold, left, right, value = [], [], [], [], []
        lines = iter([x.strip() for x in body.splitlines() if x.strip()])

        def read() -> int:
            line, at = next(lines), len(feature)
            for a, v in ((feature, 0), (threshold, 0.0), (left, at), (right, at), (value, 0.0)):
                a.append(v)
            if line.startswith("Predict:"):
                value[at] = float(line.split(":")[1]) * weights[number]
                return at
            rule = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
            feature[at], threshold[at] = int(rule[1]), float(rule[2])
            left[at] = read()
            next(lines)  # the matching Else
            right[at] = read()
            return at

        read()
        out.append(tuple(np.array(a) for a in (feature, threshold, left, right, value)))
    return out


def fit(pages: DataFrame) -> list[tuple[np.ndarray, ...]]:
    """The forest, learned from a bounded draw of ``pages`` (page_id, html)."""
    count = pages.count()
    if not count:
        return []
    draw = F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = pages.where(draw < min(1.0, FIT_PAGES / count)).select(F.col("page_id").cast("string").alias("page_id"), F.col("html").cast("string").alias("html"))
    rows = cut_lineage(drawn.mapInArrow(_training_rows(-(-FIT_SKINS // min(count, FIT_PAGES))), "label double, x array<double>").coalesce(6))
    if rows.select("label").distinct().count() < 2:
        return []
    boost = GBTClassifier(featuresCol="v", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, maxBins=32, subsamplingRate=1.0)
    model = boost.fit(rows.select("label", array_to_vector("x").alias("v")))
    return _trees(model.toDebugString, list(model.treeWeights))


def log_odds(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    every = np.arange(len(x))
    for feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            at = np.where(x[every, feature[at]] <= threshold[at], left[at], right[at])
        total += value[at]
    return 2 * total


def _extract(trees: list[tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            for lo in range(0, batch.num_rows, 64):
                parsed = [htmltree.parse(x or "") for x in batch.column("_html").slice(lo, 64).to_pylist()]
                found = [htmltree.features(nodes) for nodes, _ in parsed]
                rows = [row for _, rs in found for row in rs]
                odds = log_odds(trees, np.array(rows)).tolist() if rows else []
                at = 0
                for (nodes, blocks), (ids, rs) in zip(parsed, found):
                    own = odds[at : at + len(rs)]
                    at += len(rs)
                    kept = htmltree.decode(nodes, ids, own, STAY)
                    out.append("\n".join(t for i, t in blocks if i in kept))
            yield pa.RecordBatch.from_arrays([batch.column("_rest"), pa.array(out, pa.string())], ["_rest", "_out"])

    return run


def main_text(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``pages`` (page_id, html, ...) plus text and n_chars (code points)."""
    trees = fit(pages)
    rows = pages.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("_rest"), F.col("html").cast("string").alias("_html"))
    kind = rows.schema["_rest"].dataType.simpleString()
    done = rows.mapInArrow(_extract(trees), f"_rest {kind}, _out string")
    return done.select(*[F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(keep)], F.col("_out").alias("text"), F.char_length("_out").cast("long").alias("n_chars"))
