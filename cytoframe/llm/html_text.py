"""Main text of web pages: gradient-boosted trees over DOM nodes, and a decoding that respects the tree.

Every block element gets features of its subtree (text, links, punctuation, controls, tags), of its attribute tokens (two lists of known ones, and each of the
tokens that the fitted pages use most, on the element and above it), depth, siblings and ancestors. The trees give the probability that its subtree holds main text. Of all labellings
in which the parent of a main node is main too, dynamic programming over the tree takes the likeliest, so no
ancestor contradicts a descendant. The own text of main nodes, in page order, is the result.

The trees are fitted here, once per driver, to pages made by ``examples`` with known main text; the fitted arrays, some KB, go
to the executors. Extraction is a map over Arrow batches without a shuffle; the whole page is read.

Text that is hidden by an attribute, and that of math, svg, object and canvas elements, counts like other text: what is left out is decided by the trees, but for
scripts, styles, templates, frames' and scripts' fallbacks, the window's title and form controls.

Defined cases: null and empty pages, and pages without main text, give the empty text; broken and cut-off markup is read
leniently; pages of any length are read whole; repeated rows are treated alike; a null page_id or url passes through; an empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cytoframe.llm.common import sparing
from cytoframe.llm.html_dom import Node, parse

#: Attribute tokens, fixed lists.
MAIN_TOKENS = frozenset("article content main post entry story body text prose blog news page copy readable document single".split())
OTHER_TOKENS = frozenset(
    "nav navigation menu navbar ad ads advert adverts advertisement banner sponsor sponsored promo promotion sidebar side aside rail widget footer foot header head masthead"
    " comment comments reply replies respond discussion disqus cookie cookies notice notices consent gdpr privacy alert popup modal overlay subscribe newsletter signup login"
    " form search related recommended recommendations more share sharing social follow breadcrumb breadcrumbs pagination pager tags copyright legal skip toolbar topbar logo".split()
)
COMMENT_TOKENS = frozenset("comment comments reply replies respond discussion disqus thread".split())
AD_TOKENS = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo promotion".split())
TAGS = ("article", "main", "section", "div", "p", "h1", "li", "ul", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "body", "html", "head")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav header footer aside form menu button label dialog head".split())
BINS, TREES, DEPTH, RATE = 32, 60, 4, 0.2
#: Attribute tokens that get features of their own.
TOKENS = 48


def frequent_tokens(pages: list[list[Node]], most: int = TOKENS) -> tuple[str, ...]:
    """The attribute tokens that occur on most elements, ties by name."""
    seen = Counter(t for nodes in pages for x in nodes for t in x.tokens)
    return tuple(t for t, _ in sorted(seen.items(), key=lambda item: (-item[1], item[0]))[:most])


def token_features(nodes: list[Node], places: dict[str, int]) -> np.ndarray:
    """Of each node and token: 2 if the node has it, 1 if a node above it has."""
    out = np.zeros((len(nodes), len(places)), np.float32)
    index = {id(x): i for i, x in enumerate(nodes)}
    marked: dict[int, set[int]] = {}
    for i, x in enumerate(nodes):
        above = marked.get(index[id(x.parent)]) if x.parent else None
        own = [places[t] for t in x.tokens if t in places] if x.tokens else []
        if above or own:
            marked[i] = (above or set()).union(own)
            if above:
                out[i, list(above)] = 1
            out[i, own] = 2
    return out


def features(nodes: list[Node], places: dict[str, int]) -> np.ndarray:
    """One row for each node; places are those of the tokens with features of their own."""
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    own = [sum(len(t) for _, t in x.texts) for x in nodes]
    total, links, controls, points, paragraphs, blocks = own[:], [x.links for x in nodes], [x.controls for x in nodes], [sum(t.count(".") + t.count(",") for _, t in x.texts) for x in nodes], [x.tag == "p" for x in nodes], [1] * n
    for i in range(n - 1, 0, -1):
        p = index[id(nodes[i].parent)]
        for a in (total, links, controls, points, paragraphs, blocks):
            a[p] += a[i]
    depth, main_above, other_above, boiler_above, comment_above, ad_above, article_above, main_tag = ([0] * n for _ in range(8))
    rows = []
    all_text = max(1, total[0])
    before = 0
    for i, x in enumerate(nodes):
        p = index[id(x.parent)] if x.parent else 0
        if i:
            depth[i] = depth[p] + 1
        main_here, other_here = len(x.tokens & MAIN_TOKENS), len(x.tokens & OTHER_TOKENS)
        main_above[i], other_above[i] = main_above[p] + main_here, other_above[p] + other_here
        boiler_above[i] = boiler_above[p] + (x.tag in BOILER_TAGS)
        comment_above[i] = comment_above[p] + bool(x.tokens & COMMENT_TOKENS)
        ad_above[i] = ad_above[p] + bool(x.tokens & AD_TOKENS)
        article_above[i] = article_above[p] + (x.tag == "article")
        main_tag[i] = main_tag[p] + (x.tag in ("main", "article"))
        siblings = nodes[p].children if x.parent else [x]
        size = max(1, total[i])
        rows.append((
            math.log1p(total[i]), math.log1p(own[i]), links[i] / size, points[i] / size, controls[i], paragraphs[i], size / blocks[i], total[i] / all_text,
            depth[i], len(siblings), total[i] / max(1, total[p]), links[p] / max(1, total[p]), math.log1p(total[p]), points[p] / max(1, total[p]), paragraphs[p],
            main_here, other_here, main_above[i], other_above[i], boiler_above[i], comment_above[i], ad_above[i], article_above[i], main_tag[i],
            before / all_text, x.hidden, x.tag in HEADINGS, len(x.children), *(x.tag == t for t in TAGS), *(nodes[p].tag == t for t in TAGS[:13]),
        ))
        before += own[i]
    return np.concatenate([np.array(rows, dtype=np.float32), token_features(nodes, places)], axis=1)


@dataclass
class Trees:
    """Boosted trees of one depth as arrays: by tree, the feature and cut of each inner node, and leaf values."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float
    tokens: tuple[str, ...] = ()

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while at[0] < inner if len(at) else False:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Gradient boosting of the logistic loss with trees of equal depth over binned features."""
    m = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    b = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    share = y.mean()
    out = Trees(np.zeros((trees, 2**depth - 1), int), np.full((trees, 2**depth - 1), np.inf, np.float32), np.zeros((trees, 2**depth)), float(np.log(share / (1 - share))))
    logit = np.full(len(y), out.bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), int)
        for level in range(depth):
            k = 2**level
            inside = at - (k - 1)
            best = np.full(k, 1e-6)
            where = np.zeros(k, int)
            value = np.full(k, BINS)
            for j in range(m):
                key = inside * BINS + b[:, j]
                sg, sh = np.bincount(key, g, k * BINS).reshape(k, BINS), np.bincount(key, h, k * BINS).reshape(k, BINS)
                cg, ch = np.cumsum(sg, 1), np.cumsum(sh, 1)
                gain = cg**2 / (ch + 1) + (cg[:, -1:] - cg) ** 2 / (ch[:, -1:] - ch + 1) - cg[:, -1:] ** 2 / (ch[:, -1:] + 1)
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(1)
                better = gain[np.arange(k), top] > best
                best[better], where[better], value[better] = gain[np.arange(k), top][better], j, top[better]
            for i in range(k):
                if value[i] < BINS:
                    out.feature[t, k - 1 + i], out.cut[t, k - 1 + i] = where[i], cuts[where[i]][value[i]]
            right = b[np.arange(len(y)), where[inside]] > value[inside]
            at = 2 * at + 1 + right
        leaf = at - (2**depth - 1)
        out.leaf[t] = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        logit += out.leaf[t][leaf]
    return out


def decode(nodes: list[Node], logit: np.ndarray) -> list[bool]:
    """The likeliest labelling in which the parent of a main node is main."""
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    inside, outside = yes.tolist(), no.tolist()
    for i in range(n - 1, 0, -1):
        p = index[id(nodes[i].parent)]
        inside[p] += max(inside[i], outside[i])
        outside[p] += outside[i]
    out = [False] * n
    for i, x in enumerate(nodes):
        out[i] = inside[i] > outside[i] and (x.parent is None or out[index[id(x.parent)]])
    return out


def text_of(nodes: list[Node], main: list[bool]) -> str:
    return " ".join(t for _, t in sorted(t for x, m in zip(nodes, main, strict=True) if m for t in x.texts))


def examples(seed: int, pages: int) -> Iterator[tuple[str, str]]:
    """Made pages, as (html, mark); text whose words begin with the mark is main text."""
    r = random.Random(seed)

    def words(n: int, mark: str = "") -> str:
        out = [mark + "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 10))) + r.choice(["", "", "", "", ",", ".", "***", " |"] if r.random() < 0.3 else ["", "", "", "", "", ",", "."]) for _ in range(n)]
        return " ".join(out) + r.choice([".", "", ".", "!"])

    link = lambda: f'<a href="/{words(1)}">{words(r.randint(1, 4))}</a>'
    items = lambda n: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"
    div = lambda names, inner, tag="div": f'<{tag} {r.choice(["class", "id", "class"])}="{r.choice(names)}">{inner}</{tag}>'
    some = lambda lo, hi: words(r.randint(lo, hi))
    length = lambda: r.choice([1, 3, 8, 20, 40, 80, 200])

    def body(mark: str) -> str:
        out = [f"<h1>{words(r.randint(1, 10), mark)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 2, 3, 6, 12, 20])):
            kind = r.random()
            text = words(length(), mark)
            if kind < 0.72:
                out.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<div>{text}</div>"]))
            elif kind < 0.8:
                out.append(f"<h2>{words(r.randint(1, 6), mark)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{words(r.randint(1, 15), mark)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{words(3, mark)}</td><td>{words(2, mark)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.95:
                out.append(f"<pre>{text}</pre>")
            elif kind < 0.97:
                out.append(f'<p>{text} <a href="/x">{words(2, mark)}</a> {words(4, mark)}</p>')
            else:
                out.append(noise())
        if r.random() < 0.25:
            out.append(r.choice([comments, share, related])())
        return "".join(out)

    share = lambda: div(["share", "social-links", "share-buttons"], "".join(f"<button>{some(1, 2)}</button>" for _ in range(3)) + link())
    related = lambda: div(["related", "related-posts", "recommended", "read-more"], f"<h3>{some(1, 3)}</h3>" + items(r.randint(2, 6)), r.choice(["div", "section", "aside"]))
    comments = lambda: div(["comments", "comment-list", "discussion", "replies", "user-comments"], f"<h3>{some(1, 3)}</h3>" + "".join(div(["comment", "comment-body", "reply"], f"<p>{words(length())}</p>", r.choice(["div", "li", "article"])) for _ in range(r.randint(1, 5))), r.choice(["div", "section", "ol"]))
    noise = lambda: r.choice([lambda: div(["ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo"], f"<p>{some(3, 30)}</p>" if r.random() < 0.4 else some(3, 30), r.choice(["div", "div", "aside", "section"])), share, related, lambda: f"<form><label>{some(1, 4)}</label><input><button>{some(1, 2)}</button></form>", lambda: div(["newsletter", "signup", "subscribe"], f"<p>{some(4, 20)}</p><form><input><button>{some(1, 2)}</button></form>"), lambda: f"<aside>{some(3, 40)}</aside>"])()
    notice = lambda: div(["cookie-notice", "cookie", "consent", "gdpr-banner", "notice", "alert"], (f"<p>{some(6, 40)}</p>" if r.random() < 0.6 else some(6, 40)) + (f"<button>{some(1, 2)}</button>" if r.random() < 0.7 else ""), r.choice(["div", "section", "aside", "dialog"]))

    def unnamed() -> str:
        """A menu that no tag or token gives away."""
        inner = items(r.randint(2, 9)) if r.random() < 0.6 else " ".join(link() for _ in range(r.randint(2, 9)))
        return r.choice([f"<div>{inner}</div>", inner if inner.startswith("<ul>") else f"<p>{inner}</p>", f'<div id="{words(1)}">{inner}</div>', f'<table><tr><td class="{words(1)}">{inner}</td></tr></table>'])

    def before() -> str:
        out = [notice()] if r.random() < 0.3 else []
        if r.random() < 0.4:
            out.append(r.choice([f"<header><h1>{some(1, 4)}</h1><p>{some(2, 10)}</p></header>", f"<header>{items(4)}</header>", div(["header", "masthead", "site-header", "topbar"], some(1, 6) + (items(3) if r.random() < 0.5 else ""))]))
        if r.random() < 0.8:
            out.append(r.choice([f"<nav>{items(r.randint(2, 9))}</nav>", div(["nav", "menu", "navbar", "main-menu", "navigation"], items(r.randint(2, 9)))]))
        if r.random() < 0.2:
            out.append(unnamed())
        if r.random() < 0.2:
            out.append(div(["breadcrumb", "breadcrumbs"], f"{link()} &gt; {link()} &gt; {some(1, 4)}", r.choice(["div", "nav"])))
        out += [noise() for _ in range(r.choice([0, 0, 1, 1, 2]))]
        return "".join(out)

    def after() -> str:
        out = [noise() for _ in range(r.choice([0, 0, 0, 1, 2]))]
        if r.random() < 0.1:
            out.append(unnamed())
        if r.random() < 0.3:
            out.append(comments())
        if r.random() < 0.35:
            out.append(r.choice([f"<aside>{some(5, 60)}{items(3) if r.random() < 0.5 else ''}</aside>", div(["sidebar", "right-rail", "side", "widget-area"], f"<h3>{some(1, 3)}</h3><p>{words(length())}</p>" + (items(4) if r.random() < 0.6 else ""))]))
        if r.random() < 0.3:
            out.append(notice())
        if r.random() < 0.85:
            out.append(r.choice([f"<footer>&copy; {some(2, 14)} {link() if r.random() < 0.4 else ''}</footer>", f"<footer><p>{some(3, 25)}</p></footer>", div(["footer", "site-footer", "copyright"], some(3, 20))]))
        return "".join(out)

    for _ in range(pages):
        mark = "qqzx"
        if r.random() < 0.04:
            article = ""
        elif r.random() < 0.6:
            article = f"<article>{body(mark)}</article>"
            article = f"<main>{article}</main>" if r.random() < 0.2 else article
        else:
            article = r.choice([lambda x: f"<main>{x}</main>", lambda x: div(["content", "post-content", "entry", "article-body", "main", "story", "post"], x), lambda x: f'<div id="main"><div class="post">{x}</div></div>', lambda x: f'<section class="article">{x}</section>', lambda x: f"<div>{x}</div>"])(body(mark))
        inner = f"{before()}{article}{after()}"
        if r.random() < 0.2:
            inner = f'<div class="{r.choice(["wrapper", "container", "page", "site", "layout"])}">{inner}</div>'
        close = "</body></html>" if r.random() < 0.85 else ""
        yield f"<!DOCTYPE html><html><head><title>{words(5)}</title><style>p{{}}</style><script>var x='</p>'</script></head><body>{inner}{close}", mark


def labelled(pages: Iterator[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, tuple[str, ...]]:
    """Features of nodes, whether their subtrees hold main text, and the tokens that have features."""
    x, y = [], []
    parsed = [(parse(page), mark) for page, mark in pages]
    tokens = frequent_tokens([nodes for nodes, _ in parsed])
    places = {t: k for k, t in enumerate(tokens)}
    for nodes, mark in parsed:
        index = {id(n): i for i, n in enumerate(nodes)}
        main = [any(mark in t for _, t in n.texts) for n in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            if main[i]:
                main[index[id(nodes[i].parent)]] = True
        x.append(features(nodes, places))
        y += main
    return np.concatenate(x), np.array(y, float), tokens


@cache
def fitted(seed: int = 11, pages: int = 1500) -> Trees:
    x, y, tokens = labelled(examples(seed, pages))
    return replace(boost(x, y), tokens=tokens)


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    trees_of = [parse(p) if p else None for p in pages]
    known = [t for t in trees_of if t]
    if not known:
        return [""] * len(pages)
    places = {t: k for k, t in enumerate(trees.tokens)}
    logit = trees.logit(np.concatenate([features(t, places) for t in known]))
    out, at = [], 0
    for t in trees_of:
        if t is None:
            out.append("")
        else:
            out.append(text_of(t, decode(t, logit[at : at + len(t)])))
            at += len(t)
    return out


def main_texts(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each page."""
    trees = trees or fitted()
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text: list[str] = []
            for start in range(0, batch.num_rows, 256):
                text += extract(batch.column(2).slice(start, 256).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(sparing(run), schema)
