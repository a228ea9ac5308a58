"""Main text of web pages: a bidirectional LSTM labels every text block with the whole page in view.

A page is a sequence of blocks.  A block's vector holds its tag path (hashed words of tags, classes, ids and roles of
its ancestors, and of the innermost element apart), its words (hashed) and a few numbers.  One LSTM reads the page
forwards, one backwards; a logistic unit on both states says whether the block belongs to the article.

There are no labelled pages, so the network is trained on pages that are put together at random, seeded, from block
texts of at most ``SAMPLE_PAGES`` pages of the table: an article among menus, headers, footers, sidebars, notices, adverts,
forms, link lists and reader comments, in many markups.  Labels are known by construction, and the texts tell nothing, so
what is learned is structure.  The table itself is labelled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from html import escape
from re import findall
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.html_blocks import Block, blocks_of
from tidegate.llm.words import blocks, words_of

SAMPLE_PAGES = 200
#: Characters of each of them that lend texts; a bound of the training sample alone.
SAMPLE_CHARS = 65_536
TRAIN_PAGES = 800
PATH_CELLS, LEAF_CELLS, WORD_CELLS, NUMBERS = 160, 32, 24, 7
INPUTS = PATH_CELLS + LEAF_CELLS + WORD_CELLS + NUMBERS
HIDDEN = 16
SEED = 11


def _name_words(entry: str) -> list[str]:
    tag, *names = entry.lower().split()
    found = [tag]
    for name in names:
        found += ["." + x for x in findall(r"[a-z]+", name)]
    return found


@lru_cache(maxsize=50_000)
def _path_cells(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_CELLS + LEAF_CELLS, np.float32)
    for entry in path:
        for word in _name_words(entry):
            out[crc32(word.encode()) % PATH_CELLS] = 1
    if path:
        for word in _name_words(path[-1]):
            out[PATH_CELLS + crc32(b"leaf " + word.encode()) % LEAF_CELLS] = 1
    return out


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """A line of ``INPUTS`` numbers for each block of the pages, in order."""
    flat = [b for page in pages for b in page]
    out = np.zeros((len(flat), INPUTS), np.float32)
    if not flat:
        return out
    for i, b in enumerate(flat):
        out[i, : PATH_CELLS + LEAF_CELLS] = _path_cells(b.path)
    w = words_of(pa.array([b.text for b in flat], pa.large_string()))
    n = np.maximum(w.n, 1)
    cell = (w.hash % np.uint64(WORD_CELLS)).astype(np.int64)
    counts = np.bincount(w.row() * WORD_CELLS + cell, minlength=len(flat) * WORD_CELLS).reshape(-1, WORD_CELLS)
    at = PATH_CELLS + LEAF_CELLS
    out[:, at: at + WORD_CELLS] = counts / n[:, None]
    size = np.array([len(b.text) for b in flat])
    place = np.concatenate([np.arange(len(p)) / max(1, len(p)) for p in pages if p])
    total = np.concatenate([np.full(len(p), len(p)) for p in pages if p])
    out[:, at + WORD_CELLS:] = np.stack([
        np.log1p(size) / 8, np.log1p(w.n) / 6, np.array([b.linked for b in flat]) / np.maximum(size, 1),
        np.array([b.text[-1] in ".!?" for b in flat]), place, np.log1p(total) / 6, np.minimum(1, size / n / 20)], axis=1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """Weights of both directions: input to gates, state to gates, bias; gates are input, forget, output, candidate."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, INPUTS ** -0.5, (INPUTS, 4 * HIDDEN))
            self.p["h" + d] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN))
            self.p["b" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p["o"], self.p["c"] = rng.normal(0, 0.1, 2 * HIDDEN), np.zeros(1)

    @staticmethod
    def _order(n: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """(block index by step and page, mask); pages longest first, a backward pass starts at each page's end."""
        first = np.cumsum(n) - n
        by = np.argsort(-n, kind="stable")
        step = np.arange(int(n.max()))[:, None]
        mask = step < n[by]
        index = first[by] + (n[by] - 1 - step if backwards else step)
        return np.where(mask, index, 0), mask

    def _run(self, z: np.ndarray, n: np.ndarray, d: str, keep: bool):
        index, mask = self._order(n, d == "b")
        live = mask.sum(axis=1)
        h = np.zeros((len(n), HIDDEN), z.dtype)
        c = np.zeros_like(h)
        out = np.zeros((len(z), HIDDEN), z.dtype)
        wh, past = self.p["h" + d].astype(z.dtype), []
        for t, m in enumerate(live.tolist()):
            g = z[index[t, :m]] + h[:m] @ wh
            gates, cand = _sigmoid(g[:, : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN:])
            i, f, o = np.split(gates, 3, axis=1)
            before_c, before_h = c[:m].copy() if keep else None, h[:m].copy() if keep else None
            c[:m] = f * c[:m] + i * cand
            squashed = np.tanh(c[:m])
            h[:m] = o * squashed
            out[index[t, :m]] = h[:m]
            if keep:
                past.append((index[t, :m], i, f, o, cand, before_c, before_h, squashed))
        return out, past

    def logits(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """One number for each block; ``n`` holds the blocks of each page, none of them 0."""
        both = [self._run(x @ self.p["x" + d].astype(x.dtype) + self.p["b" + d].astype(x.dtype), n, d, False)[0]
                for d in "fb"]
        return np.concatenate(both, axis=1) @ self.p["o"].astype(x.dtype) + self.p["c"].astype(x.dtype)

    def step(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(loss, gradients) of a batch of pages, by back-propagation through time."""
        runs = {d: self._run(x @ self.p["x" + d] + self.p["b" + d], n, d, True) for d in "fb"}
        h = np.concatenate([runs["f"][0], runs["b"][0]], axis=1)
        p = _sigmoid(h @ self.p["o"] + self.p["c"])
        loss = float(-np.mean(np.log(np.where(y == 1, p, 1 - p) + 1e-12)))
        dz = (p - y) / len(y)
        grad = {"o": h.T @ dz, "c": np.array([dz.sum()])}
        for k, d in enumerate("fb"):
            dh_out = dz[:, None] * self.p["o"][None, k * HIDDEN: (k + 1) * HIDDEN]
            dg_all = np.zeros((len(x), 4 * HIDDEN))
            grad["h" + d] = np.zeros_like(self.p["h" + d])
            dh, dc = np.zeros((len(n), HIDDEN)), np.zeros((len(n), HIDDEN))
            for at, i, f, o, cand, before_c, before_h, squashed in reversed(runs[d][1]):
                m = len(at)
                dht = dh[:m] + dh_out[at]
                dct = dc[:m] + dht * o * (1 - squashed ** 2)
                dg = np.concatenate([dct * cand * i * (1 - i), dct * before_c * f * (1 - f),
                                     dht * squashed * o * (1 - o), dct * i * (1 - cand ** 2)], axis=1)
                dg_all[at] = dg
                grad["h" + d] += before_h.T @ dg
                dh[:m], dc[:m] = dg @ self.p["h" + d].T, dct * f
            grad["x" + d], grad["b" + d] = x.T @ dg_all, dg_all.sum(axis=0)
        return loss, grad

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 10, batch: int = 30, seed: int = SEED) -> Lstm:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        made = [(vectors([p]).astype(np.float64), np.array(y, float)) for p, y in pages if p]
        k = 0
        for epoch in range(epochs):
            order = rng.permutation(len(made))
            for s in range(0, len(order), batch):
                chosen = [made[i] for i in order[s: s + batch]]
                k += 1
                _, grad = self.step(np.concatenate([x for x, _ in chosen]), np.array([len(x) for x, _ in chosen]),
                                    np.concatenate([y for _, y in chosen]))
                rate = 0.02 * (1 - epoch / epochs) + 0.001
                for name, g in grad.items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.p[name] -= rate * (first[name] / (1 - 0.9 ** k)) / (np.sqrt(second[name] / (1 - 0.999 ** k)) + 1e-8)
        return self


# Markups of the training pages: an opening tag for each kind of container.
ARTICLES = ("<article>", "<main>", "<main><article>", '<div class="content">', '<div id="content">', '<div class="post">',
            '<div class="entry-content">', '<div class="article-body">', '<section class="story">', '<div id="main">',
            '<article class="post">', '<div role="main">', '<div class="text">', '<div class="page"><article>',
            '<div class="container"><div class="main-content">', '<td class="body">')
MENUS = ("<nav>", '<div class="menu">', '<div id="nav">', '<ul class="navigation">', '<div class="navbar">',
         '<div class="breadcrumb">', '<div role="navigation">', '<div class="top-menu">', '<header><nav>', '<div class="topbar">')
HEADERS = ("<header>", '<div class="header">', '<div id="header">', '<div class="masthead">', '<div class="banner">',
           '<div class="site-title">', '<div class="page-header">')
FOOTERS = ("<footer>", '<div class="footer">', '<div id="footer">', '<div class="site-footer">', '<div class="copyright">',
           '<div class="legal">', '<div class="bottom">')
SIDEBARS = ("<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<aside class="related">',
            '<div class="related">', '<div class="recommended">', '<div class="trending">', '<div class="tags">')
NOTICES = ('<div class="cookie-notice">', '<div class="cookie">', '<div id="consent">', '<div class="alert">',
           '<div class="notice">', '<div class="popup">', '<div class="modal">', '<div role="alert">', '<div class="newsletter">',
           '<div class="subscribe">', '<div class="gdpr-banner">', '<div role="dialog">')
ADVERTS = ('<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div id="ad-1">',
           '<div class="sponsored">', '<div class="promo">', '<aside class="ad">', '<div class="ad-banner">',
           '<section class="sponsor">', '<div class="adsbox">')
FORMS = ("<form>", '<form class="search">', '<form id="login">', '<div class="form"><form>', '<form class="subscribe">')
COMMENTS = ('<div class="comments">', '<section id="comments">', '<div class="comment-list">', '<ol class="comments">',
            '<section class="comments">', '<div class="reader-comments">', '<div class="discussion">', '<div class="replies">',
            '<ul class="comment-thread">', '<aside class="comments">')
SHARES = ('<div class="share">', '<div class="social">', '<div class="byline">', '<ul class="social-links">',
          '<div class="pagination">', '<div class="meta">')


def _closing(opening: str) -> str:
    return "".join(f"</{t}>" for t in reversed(findall(r"<([a-z0-9]+)", opening)))


class PageMaker:
    """Random pages of known labels; every text of an article block starts with a mark that is taken off again."""

    MARK = "\ue000"

    def __init__(self, texts: list[str], seed: int = SEED):
        self.rng = np.random.default_rng(seed)
        self.long = [t for t in texts if len(t) > 40] or ["Some words that stand for a line of a page."]
        self.words = [w for t in texts[:2_000] for w in t.split()[:6]] or ["word"]

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def some(self, low: int, high: int) -> range:
        return range(int(self.rng.integers(low, high + 1)))

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def short(self) -> str:
        return escape(" ".join(self.pick(self.words) for _ in self.some(1, 4)))

    def line(self, mark: str = "") -> str:
        text = self.pick(self.long)
        if self.chance(0.3):
            text = " ".join(text.split()[: int(self.rng.integers(1, 12))])
        return mark + escape(text)

    def links(self) -> str:
        item = self.pick(("<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> ", "<li>{}</li>", "<p><a href='#'>{}</a></p>"))
        inner = "".join(item.format(self.short()) for _ in self.some(2, 9))
        return f"<ul>{inner}</ul>" if item.startswith("<li") else inner

    def paragraphs(self, low: int, high: int, mark: str = "") -> str:
        out = []
        for _ in self.some(low, high):
            shape = self.pick(("<p>{}</p>",) * 6 + ("<p><b>{}<br>", "<p>{}", "<div>{}</div>", "<p><a href='/y'>{}</a></p>",
                                                    "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>",
                                                    "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>"))
            out.append(shape.format(self.line(mark)))
        return "".join(out)

    def box(self, kinds, inner: str) -> str:
        opening = self.pick(kinds)
        return opening + inner + _closing(opening)

    def article(self) -> str:
        opening = self.pick(ARTICLES + ("<article>",) * 6)
        title = self.pick(("<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>", "")).format(
            self.line(self.MARK))
        middle = [self.paragraphs(1, 8, self.MARK)]
        if self.chance(0.35):
            middle += [self.extra(inside=True), self.paragraphs(0, 5, self.MARK)]
        after = self.box(COMMENTS, self.comments()) if self.chance(0.12) else ""
        return opening + title + "".join(middle) + after + _closing(opening)

    def comments(self) -> str:
        shape = self.pick(("<p>{}</p>", "<li><p>{}</p></li>", '<div class="comment"><p>{}</p></div>', "<div>{}</div>",
                           '<div class="comment"><span class="author">{}</span><p>{}</p></div>', "<article><p>{}</p></article>"))
        head = self.pick(("", "<h3>Comments</h3>", "<h2>{}</h2>".format(self.short())))
        return head + "".join(shape.format(self.line(), self.line()) for _ in self.some(1, 6))

    def form(self) -> str:
        return (self.pick(("", f"<h3>{self.short()}</h3>", f"<p>{self.line()}</p>")) +
                "".join(f"<label>{self.short()}</label><input name='q'>" for _ in self.some(1, 3)) +
                self.pick(("<button>Go</button>", "<input type='submit'>", f"<p>{self.short()}</p>")))

    def extra(self, inside: bool = False) -> str:
        k = int(self.rng.integers(7))
        if k == 0:
            return self.box(ADVERTS, self.pick((self.line(), self.paragraphs(1, 2), self.links())))
        if k == 1:
            return self.box(NOTICES, self.pick((self.line(), self.paragraphs(1, 2))))
        if k == 2:
            return self.box(SIDEBARS, self.pick((f"<h3>{self.short()}</h3>", "")) + self.pick((self.links(), self.paragraphs(1, 4))))
        if k == 3:
            return self.box(FORMS, self.form())
        if k == 4 and not inside:
            return self.box(COMMENTS, self.comments())
        if k == 5:
            return self.box(SHARES, self.pick((self.links(), self.short())))
        return self.box(MENUS, self.links())

    def page(self) -> str:
        if self.chance(0.25):
            before = self.box(MENUS, self.links()) + (self.box(ADVERTS, self.line()) if self.chance(0.8) else "")
            body = before + self.article() + self.box(FOOTERS, self.line())
        else:
            before = "".join(self.pick((self.box(HEADERS, self.pick((self.short(), f"<h1>{self.short()}</h1>", self.links()))),
                                        self.box(MENUS, self.links()), self.extra())) for _ in self.some(0, 3))
            after = "".join(self.extra() for _ in self.some(0, 3)) + (
                self.box(FOOTERS, self.pick((self.line(), self.links(), self.paragraphs(1, 3)))) if self.chance(0.8) else "")
            body = before + self.article() + after
        wrap = self.pick(("", "", "", '<div class="wrapper">', '<div id="page">', '<div class="container">'))
        return f"<html><body>{wrap}{body}{_closing(wrap)}</body></html>"

    def labelled(self, n: int) -> list[tuple[list[Block], list[int]]]:
        out = []
        for _ in range(n):
            found = blocks_of(self.page())
            y = [int(b.text.startswith(self.MARK)) for b in found]
            out.append(([Block(b.path, b.text.removeprefix(self.MARK) or "x", b.linked) for b in found], y))
        return out


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> Lstm:
    """Fit on pages made of block texts of the ``sample`` pages with the smallest hash of the row.

    Pages that repeat count once.  What comes to the driver is at most ``chars`` characters of each of them.
    """
    h = F.xxhash64("page_id", "url", "html")
    chosen = pages.filter("html is not null").groupBy(h.alias("h")).agg(F.lit(1)).select("h").orderBy("h").limit(sample)
    rows = pages.filter("html is not null").select(h.alias("h"), F.substring("html", 1, chars).alias("html")).join(
        F.broadcast(chosen), "h").dropDuplicates(["h"]).collect()
    texts = [b.text for r in sorted(rows, key=lambda r: (r.h, r.html)) for b in blocks_of(r.html)]
    return Lstm().fit(PageMaker(texts).labelled(TRAIN_PAGES))


def main_texts(htmls: list[str | None], net: Lstm) -> list[str]:
    """Main text of each page: its article blocks, joined by an empty line."""
    pages = [blocks_of(h) for h in htmls]
    out = [""] * len(pages)
    full = [i for i, p in enumerate(pages) if p]
    if not full:
        return out
    n = np.array([len(pages[i]) for i in full])
    keep = net.logits(vectors([pages[i] for i in full]), n) > 0
    ends = np.cumsum(n)
    for i, s, e in zip(full, (ends - n).tolist(), ends.tolist()):
        out[i] = "\n\n".join(b.text for b, k in zip(pages[i], keep[s:e].tolist()) if k)
    return out


def extracted(pages: DataFrame, sample: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row.

    ``sample`` pages, of each at most ``sample_chars`` characters, lend texts for training; all pages are read whole.
    A null or empty page, and one without an article block, has an empty text.  Ids and urls play no part in a page's
    text (only in which pages lend texts for training); equal pages get equal texts.  Other columns play no part.
    """
    net = train(pages, sample, sample_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "html"):
                text = main_texts(block.column("html").to_pylist(), net)
                yield pa.RecordBatch.from_arrays(
                    [block.column("page_id"), block.column("url"), pa.array(text, pa.string()),
                     pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
