"""Main text of web pages: a linear-chain CRF over the leaf blocks of the page.

A page is cut into leaf blocks, the runs of text between block-level tags.
Each block carries binary features of its ancestors (tag names and the words
of their classes, ids and roles) and of its text (length, links, signs,
sentence ends). A chain of two labels, article or not, is scored by a
conditional random field whose weights are fitted by gradient ascent on the
log-likelihood of labelled pages, and decoded by Viterbi. The labelled pages
come from :func:`training_pages`, which lays out the parts of many kinds of
sites from a fixed seed; any other labelled pages may be passed to
:func:`train`.

Scripts, styles, comments and markup are never text. Character references are
decoded, white space inside a block becomes one space, blocks are joined in
page order by one space.

Defined cases: null html counts as empty; a page without article blocks gives
an empty text; broken or unclosed tags and a page cut off in mid-tag are read
as far as they go; null ids are carried through; rows that repeat are read one
by one; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import trimmed

# HTML elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())

# How sites name readers' comments.
COMMENTS = "comment comments cmt cmts reply replies discussion responses disqus reactions feedback thread ugc".split()

# A quote opens a value only right after the equals sign; an opened value that never ends is read as if it had no quote.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^=>]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("anchors", "features", "parts")

    def __init__(self, features: tuple[str, ...]) -> None:
        self.features, self.parts, self.anchors = features, [], 0

    @property
    def text(self) -> str:
        return " ".join(htmllib.unescape("".join(self.parts)).split())


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    # Long values, as of style or data attributes, rarely come again and would fill the memory.
    return (_known_names if len(attributes) <= 2000 else _known_names.__wrapped__)(tag, attributes)


@lru_cache(maxsize=4096)
def _known_names(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element tells of itself: its tag and the words of its class, id and role."""
    out = [f"tag:{tag}"]
    for _, value in ATTRIBUTE.findall(attributes):
        out += [f"name:{w.lower()}" for w in WORD.findall(CAMEL.sub(" ", value)) if len(w) > 1]
    return tuple(dict.fromkeys(out))


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, without those that hold no text."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    now: Block | None = None
    at, pos, link = 0, 0, 0

    def add(text: str) -> None:
        nonlocal now
        if not text or (now is None and text.isspace()):
            return
        if now is None:
            seen: dict[str, None] = {}
            for k, (_, names) in enumerate(reversed(stack)):
                for n in names:
                    seen[f"in {n}"] = None
                    if k == 0:
                        seen[f"at {n}"] = None
            now = Block(tuple(seen))
            out.append(now)
        now.parts.append(text)
        if link:
            now.anchors += len(text)

    while m := TOKEN.search(page, pos):
        if m.start() > at:
            add(page[at : m.start()])
        at = pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = m[1] == "/"
        if tag == "a":
            link = 0 if closing else 1
        if tag in RAW:
            if not closing and not (m[3] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = pos = len(page) if end is None else end.end()
            continue
        if tag in INLINE:
            if tag == "br" and now is not None:
                now.parts.append(" ")
            continue
        now, link = None, 0
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            if tag in ("p", "li", "td", "tr", "dd", "dt", "option") and stack and stack[-1][0] == tag:
                stack.pop()
            elif stack and stack[-1][0] == "p":
                stack.pop()
            stack.append((tag, _names(tag, m[3] or "")))
    if at < len(page):
        add(page[at:])
    return [b for b in out if b.text]


def features(found: Sequence[Block]) -> list[tuple[str, ...]]:
    out = []
    for i, b in enumerate(found):
        text = b.text
        n = text.count(" ") + 1
        own = [f"words:{min(int(np.log2(n)), 7)}", f"linked:{min(int(4 * b.anchors / max(len(text), 1)), 3)}", f"ends:{text[-1] in '.!?:;' }", f"commas:{min(text.count(','), 3)}", f"mark:{text[0] in '©|•·&' }"]
        own.append(f"place:{min(3, 4 * i // len(found))}")
        out.append((*b.features, *own, "any"))
    return out


class Crf:
    """Weights of (feature, label), transitions and the first label. Label 1 is article."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray, first: np.ndarray) -> None:
        self.index, self.weights, self.moves, self.first = index, weights, moves, first

    def scores(self, rows: Sequence[tuple[str, ...]]) -> np.ndarray:
        out = np.zeros((len(rows), 2))
        for i, row in enumerate(rows):
            ids = [self.index[f] for f in row if f in self.index]
            out[i] = self.weights[ids].sum(axis=0)
        return out

    def decode(self, rows: Sequence[tuple[str, ...]]) -> list[int]:
        """Viterbi."""
        s = self.scores(rows).tolist()
        (a, b), ((m00, m01), (m10, m11)) = self.first.tolist(), self.moves.tolist()
        a, b = a + s[0][0], b + s[0][1]
        back = []
        for x, y in s[1:]:
            back.append((a + m00 < b + m10, a + m01 < b + m11))
            a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train(pages: Sequence[tuple[str, Sequence[int]]], rounds: int = 80, rate: float = 0.15, decay: float = 0.02) -> Crf:
    """Fit on pages and the labels of their blocks: gradient ascent with per-weight steps, forward and backward sums on each chain."""
    chains = [(features(blocks(p)), np.asarray(y)) for p, y in pages]
    names = sorted({f for rows, _ in chains for row in rows for f in row})
    index = {f: i for i, f in enumerate(names)}
    k = len(names)
    ids = [[np.array([index[f] for f in row]) for row in rows] for rows, _ in chains]
    theta = np.zeros(2 * k + 4 + 2)
    speed = np.zeros_like(theta)

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return x[: 2 * k].reshape(k, 2), x[2 * k : 2 * k + 4].reshape(2, 2), x[2 * k + 4 :]

    flat = [np.concatenate(r) for r in ids]
    owner = [np.repeat(np.arange(len(r)), [len(x) for x in r]) for r in ids]
    for _ in range(rounds):
        w, moves, first = parts(theta)
        grad = -decay * theta
        gw, gm, gf = parts(grad)
        for f, o, (_rows, y) in zip(flat, owner, chains, strict=True):
            n = len(y)
            s = np.zeros((n, 2))
            np.add.at(s, o, w[f])
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            alpha[0] = first + s[0]
            for i in range(1, n):
                alpha[i] = np.logaddexp(alpha[i - 1, 0] + moves[0], alpha[i - 1, 1] + moves[1]) + s[i]
            for i in range(n - 2, -1, -1):
                beta[i] = np.logaddexp(moves[:, 0] + s[i + 1, 0] + beta[i + 1, 0], moves[:, 1] + s[i + 1, 1] + beta[i + 1, 1])
            z = np.logaddexp(*alpha[-1])
            gap = np.eye(2)[y] - np.exp(alpha + beta - z)
            np.add.at(gw, f, gap[o])
            gf += gap[0]
            if n > 1:
                joint = np.exp(alpha[:-1, :, None] + moves[None] + s[1:, None, :] + beta[1:, None, :] - z)
                gm += np.array([[((y[:-1] == a) & (y[1:] == b)).sum() for b in (0, 1)] for a in (0, 1)]) - joint.sum(axis=0)
        speed += grad**2
        theta = theta + rate * grad / np.sqrt(speed + 1e-8)
    w, moves, first = parts(theta)
    return Crf(index, w, moves, first)


def training_pages(count: int = 120, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Pages of many layouts with the label of each block, the same at each call."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def words(n: int) -> str:
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 11))) for _ in range(n))

    def sentence() -> str:
        w = words(r.choice((1, 2, 3, 5, 8, 13, 21)))
        if r.random() < 0.15:
            w = " ".join(x + r.choice(("%%%", "###", "***", "!!", " |", "&amp;&amp;")) for x in w.split())
        return w.capitalize() + r.choice((".", ".", ".", "", "?", ",", "!"))

    def paragraph() -> str:
        inner = " ".join(sentence() for _ in range(r.choice((1, 1, 2, 4, 8))))
        if r.random() < 0.15:
            inner = f'<a href="/{words(1)}">{inner}</a>' if r.random() < 0.3 else f'{inner} <a href="/x">{words(2)}</a> <b>{words(1)}</b>'
        return inner

    def article() -> list[tuple[str, int]]:
        out: list[tuple[str, int]] = [(f"<h1>{words(r.randint(1, 9)).capitalize()}</h1>", 1)] if r.random() < 0.9 else []
        for _ in range(r.choice((0, 1, 2, 4, 7, 12))):
            kind = r.random()
            if kind < 0.68:
                out.append((f"<p>{paragraph()}</p>", 1))
            elif kind < 0.74:
                out.append((f"<p><b>{paragraph()}<br>", 1))
            elif kind < 0.80:
                out.append((f"<{(h := r.choice(('h2', 'h3', 'h4')))}>{words(3)}</{h}>", 1))
            elif kind < 0.85:
                out += [("<ul>", -1), *((f"<li>{paragraph()}</li>", 1) for _ in range(r.randint(1, 4))), ("</ul>", -1)]
            elif kind < 0.89:
                out.append((f"<blockquote>{paragraph()}</blockquote>", 1))
            elif kind < 0.92:
                out.append((f"<pre>{paragraph()}</pre>", 1))
            else:
                out.append((boiler(r.choice(("ad", "share", "related", "newsletter")), "div"), 0))
        return out

    def boiler(name: str, tag: str | None = None) -> str:
        tag = tag or "div"
        shown = name if r.random() < 0.75 else f"{name}-{r.choice(('box', 'wrap', 'container', 'inner', 'block'))}"
        return f'<{tag} {r.choice(("class", "class", "id"))}="{shown}">{paragraph()}</{tag}>'

    def menu() -> list[tuple[str, int]]:
        items = [(f'<li><a href="/{words(1)}">{words(r.randint(1, 3))}</a></li>', 0) for _ in range(r.randint(1, 8))]
        opened = r.choice(("<nav><ul>", "<nav><ul>", '<div class="menu"><ul>', '<ul class="nav">', '<div id="navigation"><ul>', '<nav class="breadcrumb"><ul>'))
        return [(opened, -1), *items, ("".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened))), -1)]

    pages = []
    for _ in range(count):
        parts: list[tuple[str, int]] = []
        if r.random() < 0.9:
            parts += menu()
        if r.random() < 0.5:
            parts += [("<header>", -1), (f"<p>{paragraph()}</p>", 0), ("</header>", -1)]
        for name in r.sample(("ad", "ads", "advert", "advertisement", "banner", "sponsor", "promo", "cookie", "consent", "notice", "popup", "modal", "alert", "subscribe", "social", "breadcrumb"), r.randint(0, 3)):
            parts.append((boiler(name, r.choice(("div", "div", "section", "p"))), 0))
        shell = r.choice(("<article>", "<article>", "<article>", '<article class="post">', "<main>", '<main id="main">', "<main><article>", '<div class="content">', '<div id="article-body">', '<div class="post-content">', '<div class="entry">', '<section class="story">'))
        parts += [(shell, -1), *article(), ("".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", shell))), -1)]
        if r.random() < 0.4:
            box = r.choice(("<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="widget">', '<div class="related">'))
            parts += [(box, -1), *((f"<p>{paragraph()}</p>", 0) for _ in range(r.randint(1, 3))), (f"</{box[1:].split()[0].rstrip('>')}>", -1)]
        if r.random() < 0.4:
            name, one = r.choice(COMMENTS), r.choice(COMMENTS)
            box = r.choice((f'<section class="{name}">', f'<div id="{name}">', f'<div class="{name}-list">', f'<ol class="{name}">', f'<section id="{name}" class="{one}">'))
            inner = r.choice((f'<div class="{one}"><p>%s</p></div>', f'<div class="{one}-body">%s</div>', f'<article class="{one}"><p>%s</p></article>', f'<li class="{one}">%s</li>'))
            lone = r.random() < 0.25
            parts += [(inner.replace("%s", paragraph()), 0)] if lone else [(box, -1), *((inner.replace("%s", paragraph()), 0) for _ in range(r.randint(1, 4))), (f"</{box[1:].split()[0]}>", -1)]
        if r.random() < 0.3:
            parts += [(f'<form action="/s"><label>{words(2)}</label><input name="q"><button>{words(1)}</button></form>', 0)]
        if r.random() < 0.9:
            parts += [("<footer>", -1), (f"&copy; {words(1)} &middot; {paragraph()}", 0), ("</footer>", -1)] if r.random() < 0.7 else [(f'<div class="footer">&copy; {paragraph()}</div>', 0)]
        page, labels = "<!DOCTYPE html><html><head><title>t</title></head><body>", []
        for markup, label in parts:
            if label >= 0:
                n = len(blocks(f"<div>{markup}"))
                labels += [label] * n
            page += markup
        page += "</body></html>"
        if labels and len(blocks(page)) == len(labels):
            pages.append((page, labels))
    return pages


def main_text(page: str | None, model: Crf) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return " ".join(b.text for b, y in zip(found, model.decode(features(found)), strict=True) if y)


def extract(pages: DataFrame, model: Crf, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(x, model) for x in b["html"]]
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = lambda c: pages.schema[c].dataType.simpleString()
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return own.mapInPandas(trimmed(run), f"id {kind(id_col)}, url {kind(url_col)}, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
