"""HTML main-text extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between the starts
and ends of block-level elements.  A block's vector is made of the hashed tokens
of its whole tag path (tags, classes, ids, roles), all its hashed words, and a few
figures.
A bidirectional LSTM in numpy reads the whole sequence, so each block is labelled
in the context of the whole page; blocks labelled as main text are joined.

The labeller is trained here on pages that a seeded generator lays out, for which
every block's label is known: articles in varied containers, among and around
menus, headers, footers, sidebars, notices, adverts, forms and comments.  The
training set's size is a parameter, and the corpus plays no part in it.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brontide.llm.common import Plain, appended, small_batches, with_columns

PATH_BUCKETS, WORD_BUCKETS = 1024, 512
PATH_DIM, WORD_DIM, FIGURES, HIDDEN = 16, 8, 8, 16
INPUT = PATH_DIM + WORD_DIM + FIGURES
TRAINING_PAGES, EPOCHS, BATCH, SEED = 900, 8, 24, 3

#: Elements of HTML that are void, whose content is no text, or that stand inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style template noscript iframe object svg annotation annotation-xml mphantom canvas textarea select option head title datalist audio video".split())
RAW = frozenset("script style textarea title iframe noscript template select".split())
_MATH = "math annotation annotation-xml maction menclose merror mfenced mfrac mglyph mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics"
#: Elements that hide their content only where they have an end tag.
HIDES = frozenset("svg object annotation annotation-xml mphantom".split())
INLINE = frozenset(f"a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr {_MATH}".split())
#: Elements that may stand in a line too; they and what they hide or show end no block.
PHRASING = INLINE | frozenset("area audio button canvas datalist embed iframe input link map meta meter noscript object optgroup option output param picture progress script select slot source style svg template textarea track video".split())
#: Elements that may stand in head; another one, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Which open elements an opening tag closes, and where the search for one ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_P_SCOPE = frozenset("table td th button object html body".split())

# Possessive throughout, and no "<" outside quotes: an unfinished tag is given up at the next "<", so scanning stays linear.
_TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*+>?|<\?[^>]*+>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_HIDES = re.compile(rf"<!--.*?(?:-->|$)|<(/?)({'|'.join(sorted(HIDES))})(?=[\s/>])((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PARTS = re.compile(r"[a-z]+|\d+")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Step:
    """An open element of a block's path: its tokens, and the step above it.  Blocks share the steps they have in common."""

    __slots__ = ("above", "names", "size")

    def __init__(self, above: Step | None, names: tuple[str, ...]):
        self.above, self.names, self.size = above, names, len(names) + (above.size if above else 0)


@dataclass
class Paths:
    """The steps of a page's paths, each after the one above it, and the step that each block stands in."""

    buckets: list[list[int]]
    above: list[int]  # -1 without one
    at: np.ndarray
    size: np.ndarray  # tokens on each block's path

    def sums(self, embedding: np.ndarray) -> np.ndarray:
        """For each block the sum of its whole path's embeddings; a step adds its own to the sum above it."""
        starts = np.concatenate(([0], np.cumsum([len(b) for b in self.buckets])[:-1]))
        out = np.add.reduceat(embedding[[v for b in self.buckets for v in b]], starts, axis=0)
        for i, a in enumerate(self.above):
            if a >= 0:
                out[i] += out[a]
        return out[self.at]

    def add_back(self, to: np.ndarray, d: np.ndarray) -> None:
        """Adds to `to`, by bucket, what sums() passes back for d, one row for each block."""
        back = np.zeros((len(self.above), d.shape[1]), d.dtype)
        np.add.at(back, self.at, d)
        for i in range(len(self.above) - 1, -1, -1):
            if self.above[i] >= 0:
                back[self.above[i]] += back[i]
        np.add.at(to, [v for b in self.buckets for v in b], np.repeat(back, [len(b) for b in self.buckets], axis=0))


@dataclass
class Block:
    path: Step | None
    text: str
    linked: int
    depth: int


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """The path tokens of an element: its tag and the words of its class, id and role."""
    if not attributes:
        return (tag,)
    words = [w for a in _ATTRIBUTE.finditer(attributes) for w in _PARTS.findall(_CAMEL.sub(" ", a[2]).lower()) if not w.isdigit()]
    return (tag, *(f".{w}" for w in words))


def _ended(page: str) -> set[int]:
    """Where the elements of HIDES start that have an end tag."""
    ended: set[int] = set()
    opened: dict[str, list[int]] = {tag: [] for tag in HIDES}
    for m in _HIDES.finditer(page):
        if m[2] is None:
            continue
        starts = opened[m[2].lower()]
        if not m[1]:
            if not m[3].endswith("/") or m[2].lower() == "object":
                starts.append(m.start())
        elif starts:
            ended.add(starts.pop())
    return ended


def _cut_off(rest: str) -> int:
    """Where a tag starts that the page's end cuts off; the length of rest without one.

    Text after "<" that is no tag, several words without an attribute among them, is text.
    """
    at = rest.rfind("<")
    named = re.match(r"<(?:[!?]|/?[a-zA-Z][^\s<>/]*+)", rest[at:]) if at >= 0 else None
    if not named:
        return len(rest)
    more = rest[at + named.end() :]
    return at if named[0][1] in "!?" or "=" in more or len(more.split()) < 2 else len(rest)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in page order, character references decoded and white space made one space."""
    out: list[Block] = []
    stack: list[tuple[str, Step | None, int]] = []  # with the innermost element that is not inline, and how many of those there are
    pieces: list[str] = []
    held: Counter[str] = Counter()  # open elements by tag, so that no end tag searches the stack in vain
    linked = silent = anchors = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                _, step, depth = stack[-1] if stack else ("", None, 0)
                out.append(Block(step, text, linked, depth))
            pieces.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal silent, anchors
        while len(stack) > to:
            tag = stack.pop()[0]
            held[tag] -= 1
            silent -= tag in NO_TEXT
            anchors -= tag == "a"

    def say(text: str) -> None:
        nonlocal linked
        if silent and stack and stack[-1][0] == "head" and text.lstrip()[:1] not in ("", "<"):  # not what is left of a broken tag
            pop(len(stack) - 1)
        if text and not silent:
            pieces.append(text)
            if anchors:
                linked += len(text)

    ended: set[int] | None = None
    at, low = 0, page.lower() if any(f"<{r}" in page or f"<{r.upper()}" in page for r in RAW) else ""
    while True:
        m = _TAG.search(page, at) if page.find(">", at) >= 0 or page.find("<!", at) >= 0 else None
        if not m:
            rest = page[at:]
            say(rest[: _cut_off(rest)])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            to = None
            for k in range(len(stack) - 1, -1, -1) if held[tag] > 0 else ():
                if stack[k][0] == tag:
                    to = k
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            # What ends inside a hidden element ends no block.
            if tag not in PHRASING and (not silent or (to is not None and silent == sum(x in NO_TEXT for x, *_ in stack[to:]))):
                flush()
            if to is not None:
                pop(to)
            continue
        if held["head"] > 0 and tag not in IN_HEAD:
            pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "head"))
        if tag not in PHRASING and not silent:
            flush()
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1) if held["p"] > 0 else ():
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in _P_SCOPE or stack[k][0] in NO_TEXT:
                    break
        if tag in CLOSES:
            ends, scope = CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1) if any(held[e] > 0 for e in ends) else ():
                if stack[k][0] in scope:
                    break
                if stack[k][0] in ends:
                    pop(k)
                    break
        if tag in VOID:
            if tag in ("br", "hr", "wbr", "img") and tag != "wbr":
                say(" ")
            continue
        if m[3].rstrip().endswith("/") and (tag in ("svg", "math", "path") or held["svg"] > 0 or held["math"] > 0):
            continue
        if tag == "head" and held["head"] > 0:
            continue
        if tag in HIDES:
            ended = _ended(page) if ended is None else ended
            if m.start() not in ended:
                continue
        _, step, depth = stack[-1] if stack else ("", None, 0)
        stack.append((tag, step, depth) if tag in PHRASING else (tag, Step(step, _names(tag, m[3])), depth + 1))
        held[tag] += 1
        silent += tag in NO_TEXT
        anchors += tag == "a"
        if tag in RAW:
            end = low.find(f"</{tag}", at) if len(low) == len(page) else next((x.start() for x in re.compile(f"</{tag}", re.I).finditer(page, at)), -1)
            at = len(page) if end < 0 else end
    flush()
    return out


class Buckets(dict):
    """Buckets of the tokens met so far; forgets all when it holds too many.  It travels to executors empty."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 15:
            self.clear()
        self[token] = n = zlib.crc32(token.encode("utf-8", "replace")) % self.most
        return n

    def __reduce__(self):
        return Buckets, (self.most,)


_PATH, _WORD = Buckets(PATH_BUCKETS), Buckets(WORD_BUCKETS)


def page_paths(found: list[Block]) -> Paths:
    """The paths of a page's blocks; one without elements counts as bucket 0."""
    place: dict[Step | None, int] = {}
    buckets: list[list[int]] = []
    above: list[int] = []
    for b in found:
        new, step = [], b.path
        while step not in place:
            new.append(step)
            if step is None or step.above is None:
                break
            step = step.above
        for step in reversed(new):
            place[step] = len(above)
            above.append(-1 if step is None or step.above is None else place[step.above])
            buckets.append([0] if step is None else [_PATH[t] for t in step.names])
    return Paths(buckets, above, np.array([place[b.path] for b in found], np.int64), np.array([b.path.size if b.path else 1 for b in found]))


def page_features(found: list[Block]) -> tuple[Paths, list[list[int]], np.ndarray]:
    """Paths, buckets of all words, and figures of each block of a page."""
    paths = page_paths(found)
    words, figures = [], np.zeros((len(found), FIGURES), np.float32)
    n = len(found)
    for i, b in enumerate(found):
        w = b.text.lower().split()
        words.append([_WORD[x] for x in w])
        size = len(b.text)
        figures[i] = (math.log1p(size) / 6, math.log1p(len(w)) / 5, min(1.0, b.linked / size), (i + 1) / n, math.log1p(i) / 5, math.log1p(n - i) / 5, math.log1p(b.depth) / 5, b.text[-1] in ".!?…")
    return paths, words, figures


@dataclass
class Labeller:
    """Parameters of the bidirectional LSTM; a block's score is the log odds of main text."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        p = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM))}
        for side in "fb":
            p["x" + side] = rng.normal(0, 1 / math.sqrt(INPUT), (INPUT, 4 * HIDDEN))
            p["h" + side] = rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            p["c" + side] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
        p["out"], p["bias"] = rng.normal(0, 0.3, 2 * HIDDEN + INPUT), np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, list]:
        """(steps, pages, INPUT), a mask of the same steps, and what training needs to go back to the embeddings."""
        steps = max(len(f) for _, _, f in pages)
        x = np.zeros((steps, len(pages), INPUT), np.float32)
        mask = np.zeros((steps, len(pages)), np.float32)
        for k, (paths, words, figures) in enumerate(pages):
            n = len(figures)
            mask[:n, k] = 1
            x[:n, k, PATH_DIM + WORD_DIM :] = figures
            x[:n, k, :PATH_DIM] = paths.sums(self.p["path"]) / np.sqrt(paths.size)[:, None]
            sizes = np.array([len(w) for w in words])
            some = np.flatnonzero(sizes)
            if len(some):
                flat = np.array([v for w in words for v in w])
                sums = np.add.reduceat(self.p["word"][flat], np.concatenate(([0], np.cumsum(sizes[some])[:-1])), axis=0)
                x[some, k, PATH_DIM : PATH_DIM + WORD_DIM] = sums / sizes[some][:, None]
        return x, mask, []

    def scan(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool = False) -> tuple[np.ndarray, list]:
        steps, pages, _ = x.shape
        xs = x @ self.p["x" + side] + self.p["c" + side]
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out, kept = np.zeros((steps, pages, HIDDEN), np.float32), [None] * steps
        wh = self.p["h" + side]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = xs[t] + h @ wh
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                kept[t] = (h, c, i, f, o, g, tc)
            c, h = m * new + (1 - m) * c, m * (o * tc) + (1 - m) * h
            out[t] = h
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate((self.scan(x, mask, "f")[0], self.scan(x, mask, "b")[0], x), axis=2)
        return both @ self.p["out"] + self.p["bias"][0]

    def gradients(self, pages: list[tuple], labels: list[np.ndarray]) -> tuple[dict[str, np.ndarray], float]:
        x, mask, _ = self.inputs(pages)
        hf, kf = self.scan(x, mask, "f", True)
        hb, kb = self.scan(x, mask, "b", True)
        both = np.concatenate((hf, hb, x), axis=2)
        z = both @ self.p["out"] + self.p["bias"][0]
        y = np.zeros_like(mask)
        for k, v in enumerate(labels):
            y[: len(v), k] = v
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        d = (prob - y) * mask / mask.sum()
        loss = float(-(mask * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / mask.sum())
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = np.einsum("tp,tpi->i", d, both), d.sum(keepdims=True).reshape(1)
        back = d[:, :, None] * self.p["out"]
        dx = back[:, :, 2 * HIDDEN :].copy()
        for side, kept, dh_out in (("f", kf, back[:, :, :HIDDEN]), ("b", kb, back[:, :, HIDDEN : 2 * HIDDEN])):
            wh, wx = self.p["h" + side], self.p["x" + side]
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in range(len(x) - 1, -1, -1) if side == "f" else range(len(x)):
                h, c, i, f, o, gg, tc = kept[t]
                m = mask[t][:, None]
                dh = dh + dh_out[t]
                dn = m * dh
                dcn = m * dc + dn * o * (1 - tc * tc)
                dz = np.concatenate((dcn * gg * i * (1 - i), dcn * c * f * (1 - f), dn * tc * o * (1 - o), dcn * i * (1 - gg * gg)), axis=1)
                g["h" + side] += h.T @ dz
                g["x" + side] += x[t].T @ dz
                g["c" + side] += dz.sum(axis=0)
                dx[t] += dz @ wx.T
                dh = dz @ wh.T + (1 - m) * dh
                dc = dcn * f + (1 - m) * dc
        for k, (paths, words, _) in enumerate(pages):
            paths.add_back(g["path"], dx[: len(words), k, :PATH_DIM] / np.sqrt(paths.size)[:, None])
            for t, w in enumerate(words):
                if w:
                    np.add.at(g["word"], w, dx[t, k, PATH_DIM : PATH_DIM + WORD_DIM] / len(w))
        return g, loss

    def label(self, pages: list[list[Block]], batch: int = 64) -> list[np.ndarray]:
        """For each page, which of its blocks are main text.  Pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            n = 1
            # Pages of one batch are at most twice as long as its shortest, and of bounded size together.
            while n < batch and at + n < len(order) and len(pages[order[at + n]]) <= 2 * len(pages[order[at]]) + 8 and (n + 1) * len(pages[order[at + n]]) <= 1 << 16:
                n += 1
            some = order[at : at + n]
            x, mask, _ = self.inputs([page_features(pages[i]) for i in some])
            z = self.logits(x, mask)
            for k, i in enumerate(some):
                out[i] = z[: len(pages[i]), k] > 0
            at += n
        return out


class Layouts:
    """Pages with known labels, laid out by a seeded generator."""

    #: Containers of main text, and of everything else, as opening tags.
    MAIN = ("article", "article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="article-body"', 'section class="entry"', 'div id="main"', 'div class="post-content"', 'div role="main"', 'article class="post"')
    MENU = ("nav", "nav", 'ul class="menu"', 'div class="nav"', 'div id="menu"', 'nav class="breadcrumb"', 'div role="navigation"', 'div class="navbar"')
    TOP = ("header", 'div class="header"', 'div id="header"', 'div class="masthead"', 'header class="site-header"')
    END = ("footer", "footer", 'div class="footer"', 'div id="footer"', 'div class="copyright"', 'footer class="site-footer"')
    SIDE = ("aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="widget"', 'div class="related"', 'div class="recommended"', 'section class="popular"')
    NOTE = ('div class="cookie-notice"', 'div class="cookies"', 'div id="consent"', 'div class="banner"', 'div class="notice"', 'div class="popup"', 'div class="newsletter"', 'div class="alert"', 'div role="dialog"', 'div class="gdpr"', 'div class="subscribe"')
    AD = ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'aside class="ad"', 'p class="ad"', 'div class="ad-slot"', 'div class="ad-container"', 'div class="ad-unit"')
    FORM = ("form", 'form class="search"', 'div class="login"', 'form id="signup"')
    TALK = ('section class="comments"', 'div class="comments"', 'div id="comments"', 'ul class="comment-list"', 'ol class="commentlist"', 'div class="comment"', 'section id="respond"', 'div class="replies"', 'div class="discussion"')
    SHARE = ('div class="share"', 'div class="social"', 'ul class="tags"', 'div class="pagination"')

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        self.words = ["".join(self.r.choice(list("aeiounrstldcmhp"), self.r.integers(2, 9))) for _ in range(3000)]

    def pick(self, options):
        return options[self.r.integers(len(options))]

    def text(self, lo: int, hi: int) -> str:
        n = int(math.exp(self.r.uniform(math.log(lo), math.log(hi + 1))))
        w = [self.pick(self.words) for _ in range(max(1, n))]
        return " ".join(w).capitalize() + self.pick((".", ".", ".", "", "!", "?"))

    def wrap(self, opening: str, inner: list) -> list:
        return [f"<{opening}>", *inner, f"</{opening.split()[0]}>"]

    def nest(self, inner: list) -> list:
        """inner in as many plain containers as deep pages have; few mostly, up to 100."""
        n = int(math.exp(self.r.uniform(0, math.log(100))))
        return ["<div>" * n, *inner, "</div>" * n]

    def leaf(self, label: int, tag: str, text: str) -> list:
        end = "" if tag in ("p", "li") and self.r.random() < 0.15 else f"</{tag.split()[0]}>"
        return [f"<{tag}>", (text, label), end]

    def link(self, lo: int = 1, hi: int = 3) -> str:
        return f'<a href="/x">{self.text(lo, hi)}</a>'

    def boiler(self) -> list:
        kind = self.pick(("MENU", "TOP", "END", "SIDE", "NOTE", "AD", "FORM", "TALK", "SHARE"))
        opening, r = self.pick(getattr(self, kind)), self.r
        n = int(r.integers(1, 7))
        if kind in ("MENU", "SHARE") or opening.startswith(("ul", "ol")) and kind != "TALK":
            items = [x for _ in range(n) for x in self.leaf(0, "li", self.link())]
            return self.wrap(opening, items if opening.startswith(("ul", "ol")) else self.wrap("ul", items))
        if kind == "TALK":
            inner = self.leaf(0, self.pick(("h2", "h3")), self.text(1, 3)) if r.random() < 0.5 else []
            for _ in range(n):
                item = self.leaf(0, self.pick(("p", "p", "div")), self.text(3, 80))
                inner += self.wrap(self.pick(("li", "div", 'div class="comment"', "article", 'article class="comment"', 'div class="reply"')), item) if r.random() < 0.6 else item
            return self.wrap(opening, inner)
        if kind == "FORM":
            return self.wrap(opening, [x for _ in range(n) for x in self.leaf(0, self.pick(("label", "p", "button", "div", "legend")), self.text(1, 6))])
        if r.random() < 0.35:
            return self.wrap(opening, [(self.text(2, 30), 0)])
        inner = []
        for _ in range(n):
            inner += self.leaf(0, self.pick(("p", "p", "h3", "div", "li", "h1", "span")), self.link(1, 8) if r.random() < 0.3 else self.text(1, 50))
        return self.wrap(opening, inner)

    def article(self) -> list:
        r, body = self.r, []
        if r.random() < 0.8:
            head = self.leaf(1, self.pick(("h1", "h1", "h2")), self.text(1, 12))
            body += self.wrap("header", head) if r.random() < 0.06 else head
        for _ in range(int(math.exp(r.uniform(0, math.log(28)))) - (r.random() < 0.1)):
            u = r.random()
            if u < 0.7:
                text = self.text(1, 120)
                if r.random() < 0.12:
                    text = f"<b>{text}<br>" if r.random() < 0.5 else f"{text} {self.link()} {self.text(1, 9)}"
                body += self.leaf(1, "p", text)
            elif u < 0.78:
                body += self.leaf(1, self.pick(("h2", "h3", "h4")), self.text(1, 8))
            elif u < 0.86:
                body += self.wrap(self.pick(("ul", "ol")), [x for _ in range(r.integers(1, 6)) for x in self.leaf(1, "li", self.text(1, 20))])
            elif u < 0.9:
                body += self.leaf(1, self.pick(("blockquote", "pre", "figcaption", "div")), self.text(2, 40))
            elif u < 0.93:
                body += self.wrap("table", [x for _ in range(r.integers(1, 4)) for x in self.wrap("tr", [y for _ in range(2) for y in self.leaf(1, self.pick(("td", "th")), self.text(1, 5))])])
            elif u < 0.96:
                body += [(self.text(3, 40), 1)]
            else:
                body += self.boiler()
        if r.random() < 0.25:
            body = self.wrap(self.pick(("div", "section", 'div class="body"', 'div class="text"')), body)
        return self.wrap(self.pick(self.MAIN), self.nest(body) if r.random() < 0.15 else body)

    def page(self) -> tuple[list[Block], np.ndarray]:
        r = self.r
        parts = []
        for _ in range(r.integers(0, 5)):
            parts += self.boiler()
        if r.random() < 0.97:
            main = self.article()
            if r.random() < 0.2:
                main += self.boiler() if r.random() < 0.6 else []
                main = self.wrap(self.pick(('div class="container"', 'div id="page"', "main", 'div class="wrapper"', "section")), main)
            parts += main
        for _ in range(r.integers(0, 5)):
            parts += self.boiler()
        if r.random() < 0.15:
            parts = self.nest(parts)
        # A mark in the text carries the label through the parser.
        page = "".join(x if isinstance(x, str) else f"\x01{x[1]}{x[0]}" for x in parts)
        if r.random() < 0.5:
            page = f"<html><head><title>{self.text(1, 5)}</title></head><body>{page}</body></html>"
        found = blocks(page)
        labels = []
        for b in found:
            marks = re.findall("\x01(.)", b.text)
            b.text = re.sub("\x01.", "", b.text).strip() or "x"
            labels.append(float(marks[0]) if marks else 0.0)
        return found, np.array(labels, np.float32)


@lru_cache(maxsize=2)
def trained_labeller(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller trained with Adam on generated pages; the same for the same arguments."""
    source = Layouts(seed)
    made = [x for x in (source.page() for _ in range(pages)) if x[0]]
    data = [(page_features(b), y) for b, y in made]
    m = Labeller.fresh(seed)
    first, second = ({k: np.zeros_like(v) for k, v in m.p.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            some = [data[i] for i in order[at : at + BATCH]]
            g, _ = m.gradients([f for f, _ in some], [y for _, y in some])
            step += 1
            norm = math.sqrt(sum(float((v * v).sum()) for v in g.values()))
            rate = 0.02 * 0.7**epoch * min(1.0, 5 / max(norm, 1e-9))
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                m.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return m


def main_texts(pages: list[str | None], labeller: Labeller) -> list[str]:
    """The main text of each page; empty for null, empty and textless pages."""
    found = [blocks(p or "") for p in pages]
    return ["\n\n".join(b.text for b, yes in zip(bs, keep, strict=True) if yes) for bs, keep in zip(found, labeller.label(found), strict=True)]


def extract_main_text(pages: DataFrame, column: str = "html", labeller: Labeller | None = None, keep_html: bool = False) -> DataFrame:
    """pages with text and n_chars (its code points) appended; the html column goes unless keep_html.

    Blocks stand in page order, two line ends apart; nothing is capped.  Null and
    empty pages have an empty text.  Columns of pages named as an appended one,
    in any case, are replaced.  Repeated rows give the same text.
    """
    small_batches(pages.sparkSession, 256)
    model = labeller or trained_labeller()
    made = {"text": T.StringType(), "n_chars": T.LongType()}
    table = Plain(pages, made)
    name = table.name(column)
    slim = table.slim(name)

    def run(batches):
        for b in batches:
            texts = main_texts(b.column(b.schema.names.index(name)).to_pylist(), model)
            if not keep_html:
                b = b.drop_columns([name])
            yield with_columns(b, list(made), [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())])

    return slim.mapInArrow(run, appended(slim.schema, [] if keep_html else [name], **made)).select(*table.own(*([] if keep_html else [name])), *made)
