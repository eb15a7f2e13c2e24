"""Main text of web pages: a tree-structured graphical model over the block elements of the DOM.

Each block element is a variable, content or not. Its own potential is a log-linear function of
its tag, its class and id words, and the text and links below it; a parent and a child share a
2 x 2 potential, one table for children of the body and one for all others. Sum-product messages
go up from the leaves and down from the root; text is kept where the content marginal of its
element is at least a half. The weights maximise the likelihood of labelled pages, which are made
here by a rule from several layouts, so their number is the parameter that bounds training.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"""<!--(?:.*?-->|.*+)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
#: Fixed HTML vocabulary.
BLOCKS = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup: it ends with their end tag only. That of the last is shown.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements that are no part of a text; one that is never closed ends with the block it is in.
LEFT_OUT = frozenset("template noscript select button svg datalist".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ROOTS = frozenset("table html body".split())
SCOPES = frozenset("table td th html body article aside section div form main nav header footer".split())
SKIPPED = {n: re.compile(f"(</){n}[^>]*>" + (f"|<{n}[\\s>/]" if n in LEFT_OUT else ""), re.I) for n in RAW | LEFT_OUT}
KINDS = ("html", "body", "article", "main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "nav", "header",
         "footer", "aside", "form fieldset search dialog", "table tbody thead tfoot tr", "td th", "blockquote pre", "figure figcaption details summary")
KIND = {t: i for i, ts in enumerate(KINDS) for t in ts.split()}
WORDS = ("ad ads advert advertisement sponsor sponsored promo banner", "nav menu navigation breadcrumb breadcrumbs toolbar tabs", "header masthead top logo",
         "footer copyright legal colophon bottom", "sidebar side aside rail widget complementary", "comment comments reply replies disqus discussion responses",
         "cookie cookies consent notice gdpr popup modal alert overlay", "share social related recommended more tags meta byline author date pagination",
         "form login signup subscribe newsletter search contact", "article post entry story articlebody", "content main body text prose page")
WORD_KIND = {w: i for i, ws in enumerate(WORDS) for w in ws.split()}
N_FEATURES = 1 + len(KINDS) + 1 + len(WORDS) + 12


class Page:
    """Block elements of a page in page order, and its runs of inline text.

    Open elements are a stack, with the places of each name beside it, so that a tag costs the same
    however many elements are open.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.names = ["html"], [-1], [""]
        self.runs: list[tuple[int, list[str], int]] = []  # element, text, characters in links
        self._stack: list[tuple[str, int]] = [("html", 0)]  # inline elements carry their block's number
        self._open: dict[str, list[int]] = {"html": [0]}  # places in the stack
        self._blocks = [0]
        self._links, self._fresh, self._hidden = 0, True, 0
        at, end = 0, source.rfind(">") + 1  # no tag ends beyond
        match = TOKEN.search(source, 0, end)
        while match:
            if match.start() > at:
                self._text(source[at: match.start()])
            at = match.end()
            name = match[2] or match[5]
            if name:
                name = name.lower()
                attributes = (match[3] if match[2] else match[6]) or ""
                if match[1] or match[4]:
                    self._end(name)
                elif name in RAW or name in LEFT_OUT:
                    if not attributes.endswith("/"):
                        at = self._skip(name, source, at)
                else:
                    self._start(name, attributes)
            match = TOKEN.search(source, at, end)
        if at < len(source):
            self._text(source[at:])

    def _skip(self, name: str, source: str, at: int) -> int:
        """Where to go on after the start tag of an element that is not parsed."""
        close = SKIPPED[name].search(source, at)
        if name in RAW:
            if name == "xmp":
                self._fresh = True
                self._text(html.escape(source[at: close.start() if close else len(source)]))
                self._fresh = True
            return close.end() if close else len(source)
        if close and close[1]:
            return close.end()
        self._push(name, self._stack[-1][1])  # never closed: another one starts, or none ends
        self._hidden += 1
        return at

    def _text(self, text: str) -> None:
        if self._hidden:
            return
        text = html.unescape(text)
        if self._fresh:
            if not text.strip():
                return
            self.runs.append((self._stack[-1][1], [], 0))
            self._fresh = False
        node, parts, linked = self.runs[-1]
        parts.append(text)
        if self._links:
            self.runs[-1] = (node, parts, linked + len(text.strip()))

    def _push(self, name: str, node: int) -> None:
        self._open.setdefault(name, []).append(len(self._stack))
        self._stack.append((name, node))

    def _last(self, *names: str) -> int:
        """Place of the innermost open element of these names, -1 without."""
        return max((self._open[n][-1] for n in names if self._open.get(n)), default=-1)

    def _cut(self, size: int) -> None:
        while len(self._stack) > size:
            name, _ = self._stack.pop()
            self._open[name].pop()
            self._links -= name == "a"
            self._hidden -= name in LEFT_OUT
            if name in BLOCKS:
                self._blocks.pop()
                self._fresh = True

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            if not self._fresh:
                self.runs[-1][1].append(" ")
            return
        if name in ("html", "body") and self._open.get(name):
            return
        if name in BLOCKS:
            if self._hidden:
                self._cut(min(self._open[n][0] for n in LEFT_OUT if self._open.get(n)))
            closed, stops = CLOSES.get(name, ((), SCOPES))
            bar = self._last(*stops, *ROOTS)
            if (place := self._last("p")) > bar:
                self._cut(place)
            if closed:
                row = self._last("tr") if name == "tr" else -1
                place = row if row > bar else self._last(*closed)
                if place > bar:
                    self._cut(place)
            self._fresh = True
            if name in VOID:
                return
            self.parent.append(self._stack[-1][1])
            self.tag.append(name)
            self.names.append(" ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower())
            self._blocks.append(len(self._stack))
            self._push(name, len(self.tag) - 1)
        elif name not in VOID:
            if name == "a" and self._links:
                self._end("a")
            self._links += name == "a"
            self._push(name, self._stack[-1][1])

    def _end(self, name: str) -> None:
        place = self._last(name)
        if place > 0 and (name in BLOCKS or place > self._blocks[-1]):
            self._cut(place)


class Forest:
    """Pages side by side: parents, features, and elements by depth for the messages."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tag) for p in pages])
        first = np.concatenate(([0], np.cumsum(sizes)))
        self.first = first
        parent = np.concatenate([np.array(p.parent) + (a if len(p.parent) else 0) for p, a in zip(pages, first)])
        parent[first[:-1]] = -1
        n = len(parent)
        depth = np.zeros(n, np.int64)
        for i, p in enumerate(parent.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        self.parent, self.n = parent, n
        own = np.zeros((n, 5))  # characters, those in links, words, sentence marks, runs
        for p, a in zip(pages, first):
            for node, parts, linked in p.runs:
                text = "".join(parts)
                own[a + node] += (len(text), linked, text.count(" ") + 1, sum(map(text.count, ".!?;")), 1)
        below = own.copy()
        for level in self.levels[:0:-1]:
            np.add.at(below, parent[level], below[level])
        page_chars = np.repeat(below[first[:-1], 0], sizes)
        x = np.zeros((n, N_FEATURES))
        x[:, 0] = 1
        col = 1
        kinds = np.array([KIND.get(t, len(KINDS)) for p in pages for t in p.tag])
        x[np.arange(n), col + kinds] = 1
        col += len(KINDS) + 1
        for i, names in enumerate(s for p in pages for s in p.names):
            for w in WORD.findall(names):
                if w in WORD_KIND:
                    x[i, col + WORD_KIND[w]] = 1
        col += len(WORDS)
        chars = np.maximum(below[:, 0], 1)
        density = below[:, 1] / chars
        x[:, col: col + 12] = np.stack([
            np.log1p(own[:, 0]) / 5, np.log1p(below[:, 0]) / 5, density, (density > 0.5) * 1.0, (below[:, 0] == 0) * 1.0,
            below[:, 0] / np.maximum(page_chars, 1), np.minimum(below[:, 3], 20) / 10, (below[:, 2] > 25) * 1.0, (below[:, 2] < 6) * 1.0,
            np.minimum(below[:, 2] / np.maximum(below[:, 4], 1), 60) / 30, (below[:, 3] == 0) * 1.0, np.minimum(depth, 10) / 5], 1)
        self.x = x
        self.edge = np.where(parent >= 0, kinds[np.maximum(parent, 0)] > 1, 0).astype(np.int64)  # table of the pair with its parent

    def marginals(self, weights: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Content marginals, pair marginals with the parent (n, parent's, own), log partition."""
        up = np.zeros((self.n, 2))
        up[:, 1] = self.x @ weights
        sent = np.zeros((self.n, 2))  # upward message of each element to its parent
        for level in self.levels[:0:-1]:
            sent[level] = np.logaddexp.reduce(tables[self.edge[level]] + up[level][:, None, :], axis=2)
            np.add.at(up, self.parent[level], sent[level])
        roots = self.levels[0]
        z = np.logaddexp.reduce(up[roots], axis=1)
        down = np.zeros((self.n, 2))  # belief of the parent without this child
        belief = up.copy()
        pair = np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            down[level] = belief[self.parent[level]] - sent[level]
            joint = down[level][:, :, None] + tables[self.edge[level]] + up[level][:, None, :]
            belief[level] = np.logaddexp.reduce(joint, axis=1)
            pair[level] = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(level), 4), axis=1)[:, None, None])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), pair, float(z.sum())


def _filler(r: random.Random, words: int) -> str:
    made = ["".join(r.choice(("an", "the", "ri", "sol", "mer", "ti", "on", "ka", "ver", "el", "qu", "st")) for _ in range(r.randint(1, 4))) for _ in range(words)]
    out = [w.capitalize() if i % 11 == 0 else w + (r.choice(".,") if i % 11 == 10 else "") for i, w in enumerate(made)]
    return " ".join(out) + r.choice((".", ".", "!", ""))


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """A made page and the label of each of its block elements, in page order (html, body first)."""
    r = random.Random(seed)
    out, labels = ["<!DOCTYPE html><html><head><title>t</title></head>"], [0]

    def put(tag: str, label: int, inner, names: str = "") -> None:
        labels.append(label)
        out.append(f"<{tag}{names and f' class={chr(34)}{names}{chr(34)}'}>")
        inner() if callable(inner) else out.append(inner)
        out.append(f"</{tag}>")

    def links(tag: str, names: str, n: int) -> None:
        put(tag, 0, lambda: put("ul", 0, lambda: [put("li", 0, f'<a href="/x">{_filler(r, r.randint(1, 3))}</a>') for _ in range(n)]), names)

    def short(tag: str, names: str, low: int = 2, high: int = 25) -> None:
        if r.random() < 0.5:
            put(tag, 0, _filler(r, r.randint(low, high)), names)
        else:
            put(tag, 0, lambda: put("p", 0, _filler(r, r.randint(low, high))), names)

    def comments() -> None:
        def one():
            put("div", 0, lambda: [put("p", 0, _filler(r, r.randint(3, 60))) for _ in range(r.randint(1, 2))], r.choice(("comment", "reply", "comment-body")))
        put(r.choice(("section", "div")), 0, lambda: [put("h3", 0, "Comments"), *[one() for _ in range(r.randint(1, 5))]], r.choice(("comments", "comment-list", "discussion")))

    def form() -> None:
        put("form", 0, lambda: (out.append('<input name="q"><button>Go</button>'), put("p", 0, _filler(r, r.randint(2, 15)))), r.choice(("", "newsletter", "search")))

    def ad(tag: str = "div") -> None:
        short(tag, r.choice(("ad", "advert", "sponsored", "promo banner", "ads")), 3, 40)

    def notice() -> None:
        put(r.choice(("p", "p", "div")), 0, _filler(r, r.randint(3, 40)), r.choice(("notice", "cookie-notice", "consent", "alert", "notice popup")))

    def article_parts() -> None:
        if r.random() < 0.8:
            put("h1", 1, _filler(r, r.randint(2, 14)))
        for _ in range(r.choice((1, 2, 3, 5, 8))):
            kind = r.random()
            words = r.choice((r.randint(1, 8), r.randint(5, 40), r.randint(30, 160)))
            text = _filler(r, words)
            if r.random() < 0.25:
                text = f'<b>{text}</b> <a href="/y">{_filler(r, 2)}</a>'
            if kind < 0.68:
                put("p", 1, text)
            elif kind < 0.76:
                put(r.choice(("h2", "h3")), 1, _filler(r, r.randint(1, 7)))
            elif kind < 0.84:
                put(r.choice(("ul", "ol")), 1, lambda: [put("li", 1, _filler(r, r.randint(2, 20))) for _ in range(r.randint(2, 5))])
            elif kind < 0.90:
                put(r.choice(("blockquote", "pre")), 1, text)
            elif kind < 0.94:
                put("table", 1, lambda: [put("tr", 1, lambda: [put("td", 1, _filler(r, r.randint(1, 4))) for _ in range(3)]) for _ in range(r.randint(1, 3))])
            elif kind < 0.97:
                put("figure", 1, lambda: put("figcaption", 1, _filler(r, r.randint(3, 12))))
            else:
                put("div", 1, lambda: put("p", 1, text))
            if r.random() < 0.2:
                r.choice((ad, lambda: short("aside", ""), lambda: short("div", r.choice(("share", "related", "social")), 1, 8), form, notice, notice, notice))()

    def article() -> None:
        shape = r.random()
        if shape < 0.45:
            put("article", 1, article_parts, r.choice(("", "", "post", "entry")))
        elif shape < 0.6:
            put("main", 1, article_parts)
        elif shape < 0.7:
            put("main", 1, lambda: put("article", 1, article_parts))
        elif shape < 0.9:
            put("div", 1, article_parts, r.choice(("content", "post-content", "entry", "story body", "article-body", "main", "text")))
        else:
            put("div", 1, article_parts)

    def body() -> None:
        before = [lambda: links("nav", "", r.randint(2, 8)), lambda: links("div", r.choice(("menu", "nav", "navigation", "topnav")), r.randint(2, 8)),
                  lambda: put("header", 0, lambda: (put("h2", 0, _filler(r, 3)), put("p", 0, _filler(r, r.randint(2, 12))))), lambda: short("header", ""),
                  lambda: short("div", r.choice(("header", "masthead", "top")), 1, 12), ad, ad, lambda: short("div", r.choice(("cookie-notice", "notice", "consent", "alert popup")), 4, 40),
                  lambda: links("div", "breadcrumb", 3), form]
        after = [lambda: short("footer", "", 3, 30), lambda: short("footer", "", 3, 30), lambda: short("div", r.choice(("footer", "copyright", "legal")), 3, 30), comments, comments,
                 lambda: links("aside", r.choice(("", "sidebar", "related")), r.randint(2, 6)), lambda: short("aside", r.choice(("", "sidebar")), 5, 60),
                 lambda: links("div", r.choice(("sidebar", "related", "widget")), r.randint(2, 6)), lambda: short("div", "sidebar", 5, 50), ad, form]
        for f in r.sample(before, r.randint(1, 4)):
            f()
        article()
        for f in r.sample(after, r.randint(1, 4)):
            f()

    labels_before = len(labels)
    out.append("<body>")
    labels.append(0)
    wrap = r.random() < 0.25
    put("div", 0, body, r.choice(("", "page", "wrapper", "container"))) if wrap else body()
    out.append("</body></html>")
    assert labels_before == 1
    return "".join(out), labels


@lru_cache(2)
def train(pages: int = 160, rounds: int = 250, penalty: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair tables of highest likelihood on ``pages`` labelled pages, by Adam steps."""
    made = [labelled_page(seed) for seed in range(pages)]
    forest = Forest([Page(source) for source, _ in made])
    y = np.array([v for _, labels in made for v in labels])
    assert len(y) == forest.n
    child = np.flatnonzero(forest.parent >= 0)
    theta = np.zeros(N_FEATURES + 8)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    seen_w = forest.x.T @ y
    seen_t = np.zeros((2, 2, 2))
    np.add.at(seen_t, (forest.edge[child], y[forest.parent[child]], y[child]), 1)
    for t in range(1, rounds + 1):
        weights, tables = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2)
        p, pair, _ = forest.marginals(weights, tables)
        held_t = np.zeros((2, 2, 2))
        np.add.at(held_t, forest.edge[child], pair[child])
        slope = np.concatenate((seen_w - forest.x.T @ p, (seen_t - held_t).ravel())) / pages - penalty * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope ** 2
        theta = theta + 0.08 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
    return theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2)


def main_texts(sources: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    forest = Forest(pages)
    content = forest.marginals(*model)[0] >= 0.5
    out = []
    for page, a in zip(pages, forest.first):
        blocks = (" ".join("".join(parts).split()) for node, parts, _ in page.runs if content[a + node])
        out.append("\n".join(b for b in blocks if b))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", training_pages: int = 160) -> DataFrame:
    """``id_col, text``: the main text of every row's whole page.

    Null or empty html gives the empty text, as does a page without content. Blocks keep page
    order; white space in a block becomes one space; character references are decoded; ``br`` is
    white space. Rows with null or repeated ids are pages like others; other columns are ignored; no
    rows in, no rows out. A page is parsed in time proportional to its length, in one task.
    """
    model = train(training_pages)
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                own = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(main_texts(own.column(1).to_pylist(), model), pa.string())], names=schema.names)

    return pages.select(id_col, html_col).mapInArrow(of, schema)


def op6_html_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    keyed = pages.select(F.struct("page_id", "url").alias("page"), "html")
    return extract(keyed, "page").select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"))
