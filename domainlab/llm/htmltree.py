"""Main-text extraction by a tree-structured graphical model.

Every element and text block of a page is a binary variable, content or not. A node's own
potential is a weighted sum of features (its tag, words in its class, id and role, length,
share of link text, sentence marks, place); a potential between parent and child couples
the labels along the tree. Sum-product messages go upward from the leaves and downward
from the root, which gives the exact marginals. The pages of a batch form one forest and
are computed together, one level at a time. The weights are fitted by maximum likelihood on
labelled pages (``htmlpages``): the gradient is observed minus expected features, expected
under the same marginals.

A page's text is its blocks with a content marginal of at least one half, in page order,
joined by newlines; white space in a block is one space.

Null and empty pages give an empty text. Pages may be cut off anywhere; what is open at the
end is closed. Repeated rows each get a row; an empty table gives an empty result; only the
named columns are read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from domainlab.llm import htmlpages
from domainlab.llm.htmldom import HEADINGS, SILENT, Node, parse

#: Pages that the model is fitted on, made by ``htmlpages`` from this seed.
TRAIN_PAGES = 600
TRAIN_SEED = 7

#: Words in class, id, role and name values, by what they hint at.
HINTS = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip",
    "header": "header masthead topbar banner branding logo tagline sitename",
    "footer": "footer foot bottom copyright colophon legal imprint contentinfo",
    "side": "sidebar side aside rail widget widgets complementary related recommended trending popular more "
            "links tags categories archive archives blogroll author bio",
    "advert": "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo "
              "promotion promoted commercial outbrain taboola",
    "notice": "cookie cookies consent gdpr privacy notice notification alert alertdialog dialog popup modal "
              "overlay newsletter subscribe subscription signup toast disclaimer warning paywall",
    "share": "share sharing social follow tweet facebook twitter print",
    "comment": "comment comments commentlist reply replies respond response discussion disqus thread feedback",
    "form": "form search searchbox login signin register contact captcha field",
    "content": "article articlebody content post entry story main body text maincontent page blog prose read",
    "hidden": "is-hidden hidden invisible",
}
_HINT = {w: k for k, words in HINTS.items() for w in words.split()}
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_MARKS = re.compile(r"[.!?,;:](?:\s|$)")

_TAGS = ("#root #text html body div section article main header footer nav aside form ul ol li dl dt dd p "
         "table tr td th blockquote pre figure figcaption address fieldset details summary dialog heading "
         "menu hgroup other").split()
_INNER = frozenset(("article", "main", "section"))
_OUTER = frozenset(("nav", "aside", "footer", "header", "form", "menu"))
_LENGTH = [1, 20, 40, 80, 160, 400, 1000]
_LINK = [0.0, 0.2, 0.5, 0.9]
_MARK = [0.0, 0.5, 1.5, 4.5]
FEATURES = ([f"tag:{t}" for t in _TAGS] + [f"hint:{h}" for h in HINTS]
            + [f"length:{k}" for k in range(len(_LENGTH) + 1)] + [f"link:{k}" for k in range(len(_LINK) + 1)]
            + [f"mark:{k}" for k in range(len(_MARK) + 1)] + [f"parent:{t}" for t in _TAGS]
            + ["in:list", "only-links", "only-links:inner", "copyright", "last-tenth", "first-tenth",
               "header:inner", "header:outer"])
_INDEX = {f: k for k, f in enumerate(FEATURES)}
N_FEATURES = len(FEATURES)


@cache
def _hints(attrs: str) -> tuple[int, ...]:
    return tuple({_INDEX[f"hint:{_HINT[w]}"] for w in _SPLIT.split(attrs) + attrs.split() if w in _HINT})


def _tag(n: Node) -> str:
    return "heading" if n.tag in HEADINGS else n.tag if f"tag:{n.tag}" in _INDEX else "other"


def features(nodes: list[Node]) -> list[list[int]]:
    """The active features of each node; lengths are of the whole subtree."""
    n = len(nodes)
    size, links, marks = [0] * n, [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        x = nodes[k]
        if x.text is not None:
            size[k], links[k], marks[k] = len(x.text), x.links, len(_MARKS.findall(x.text))
        if x.parent >= 0:
            size[x.parent] += size[k]
            links[x.parent] += links[k]
            marks[x.parent] += marks[k]
    out, before, total = [], 0, max(1, size[0])
    # is the nearest telling element around a node an article, or a part that goes with links
    inner = [False] * n
    for k, x in enumerate(nodes):
        inner[k] = x.tag in _INNER or x.tag not in _OUTER and x.parent >= 0 and inner[x.parent]
        tag = _tag(x)
        own = [_INDEX[f"tag:{tag}"], _INDEX[f"length:{np.searchsorted(_LENGTH, size[k], 'right')}"]]
        if size[k]:
            share = links[k] / size[k]
            own.append(_INDEX[f"link:{np.searchsorted(_LINK, share, 'left')}"])
            own.append(_INDEX[f"mark:{np.searchsorted(_MARK, marks[k], 'left')}"])
            if share >= 0.9:
                own.append(_INDEX["only-links"])
                if inner[k]:
                    own.append(_INDEX["only-links:inner"])
        if x.parent >= 0:
            own.append(_INDEX[f"parent:{_tag(nodes[x.parent])}"])
        if tag == "header":
            up = x.parent
            while up > 0 and nodes[up].tag not in _INNER:
                up = nodes[up].parent
            own.append(_INDEX["header:inner" if up > 0 else "header:outer"])
        if x.attrs:
            own += _hints(x.attrs)
        if x.text is not None:
            if "©" in x.text or "copyright" in x.text.lower():
                own.append(_INDEX["copyright"])
            if nodes[x.parent].tag == "li":
                own.append(_INDEX["in:list"])
            if before >= 0.9 * total:
                own.append(_INDEX["last-tenth"])
            elif before < 0.1 * total:
                own.append(_INDEX["first-tenth"])
            before += len(x.text)
        out.append(own)
    return out


class Forest:
    """The trees of several pages as arrays, by level."""

    def __init__(self, pages: list[list[Node]]):
        self.pages = pages
        flat, row, parent, depth, at = [], [], [], [], 0
        for nodes in pages:
            for k, f in enumerate(features(nodes)):
                flat += f
                row += [at + k] * len(f)
            parent += [x.parent + at if x.parent >= 0 else -1 for x in nodes]
            depth += [x.depth for x in nodes]
            at += len(nodes)
        self.n = at
        self.feature, self.row = np.array(flat, np.int64), np.array(row, np.int64)
        self.parent, depth = np.array(parent, np.int64), np.array(depth, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if at else []
        self.child = np.flatnonzero(self.parent >= 0)
        #: 1 for text blocks: what holds between them and their element differs
        self.kind = np.array([x.text is not None for nodes in pages for x in nodes], np.int64)

    def marginals(self, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and the joint (parent, child) probabilities of each
        node with a parent, by one upward and one downward sweep. pair[kind, a, b]: the
        potential of a child of that kind with label b under a parent with label a."""
        own = np.zeros((self.n, 2))
        own[:, 1] = np.bincount(self.row, weights=weights[self.feature], minlength=self.n)
        below = own.copy()  # own potential and all messages from children
        up = np.zeros((self.n, 2))  # message to the parent
        for level in reversed(self.levels[1:]):
            edge = pair[self.kind[level]]
            up[level] = np.logaddexp(edge[:, :, 0] + below[level, None, 0], edge[:, :, 1] + below[level, None, 1])
            np.add.at(below, self.parent[level], up[level])
        belief = below.copy()
        joint = np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            rest = belief[self.parent[level]] - up[level]  # the parent without this child
            both = rest[:, :, None] + pair[self.kind[level]] + below[level][:, None, :]
            joint[level] = both
            belief[level] = np.logaddexp(both[:, 0], both[:, 1])
        belief -= np.logaddexp(belief[:, :1], belief[:, 1:])
        joint = joint[self.child]
        if len(joint):
            joint = np.exp(joint - joint.reshape(-1, 4).max(axis=1)[:, None, None])
            joint /= joint.sum(axis=(1, 2), keepdims=True)
        return np.exp(belief[:, 1]), joint


class Model:
    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights, pair

    def texts(self, pages: list[str | None]) -> list[str]:
        forest = Forest([parse(p) for p in pages])
        p, _ = forest.marginals(self.weights, self.pair)
        out, at = [], 0
        for nodes in forest.pages:
            silent = [False] * len(nodes)
            kept = []
            for k, x in enumerate(nodes):
                silent[k] = x.parent >= 0 and silent[x.parent] or x.tag in SILENT
                if x.text is not None and not silent[k] and p[at + k] >= 0.5:
                    kept.append(x.text)
            at += len(nodes)
            out.append("\n".join(kept))
        return out


def fit(pages: list[list[Node]], labels: list[list[int]], steps: int = 200, rate: float = 0.2,
        ridge: float = 1e-3) -> Model:
    """Maximum likelihood with a ridge, by Adam."""
    f = Forest(pages)
    y = np.concatenate([np.array(x) for x in labels])
    seen = np.bincount(f.feature, weights=y[f.row], minlength=N_FEATURES)
    kind = f.kind[f.child]
    pairs = np.zeros((2, 2, 2))
    np.add.at(pairs, (kind, y[f.parent[f.child]], y[f.child]), 1)
    theta = np.zeros(N_FEATURES + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p, joint = f.marginals(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2))
        expected = np.stack([joint[kind == k].sum(axis=0) for k in (0, 1)])
        g = np.concatenate([seen - np.bincount(f.feature, weights=p[f.row], minlength=N_FEATURES),
                            (pairs - expected).ravel()]) / len(pages) - ridge * theta
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Model(theta[:N_FEATURES].copy(), theta[N_FEATURES:].reshape(2, 2, 2).copy())


@cache
def trained(n: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> Model:
    """The model fitted on n labelled pages."""
    made = [htmlpages.page(seed * 1_000_003 + k) for k in range(n)]
    pages = [parse(p) for p, _ in made]
    return fit(pages, [htmlpages.labels(nodes, content) for nodes, (_, content) in zip(pages, made)])


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per row; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                texts = model.texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
