"""Main text of web pages: a recurrent labeller over a page's sequence of text blocks.

A page is cut into leaf blocks at block-level tags. A block is described by its tag path
(tag names and character trigrams of class and id words, hashed), by its words (hashed)
and by a few numbers, some of which say how much of the page lies in the same container and
whether a heading does. A bidirectional LSTM in numpy reads the blocks in order and labels
each as main text or not, so every decision sees the whole page. The labeller is trained
on generated pages (see ``training_pages``), with a fixed seed: their main text lies in
containers with telling, foreign, cut or meaningless names, under 0 to some 40 wrappers,
and holds links. Its weights are kept in the warehouse folder under a hash of this module.

Edge cases: a null or empty page, or one without main text, gives the empty text;
unclosed tags, comments and scripts end with the page; white space is one space,
character references are decoded, blocks are joined by a line break; very long pages
are read whole; repeated rows give repeated results; an empty table gives an empty
result. Only page_id, url and html are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import batches, small_batches, texts_of

#: Elements that start a new block, elements without content, elements whose content is not text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea template".split())
#: Elements that say nothing about what they hold.
NEUTRAL = frozenset("html body b i em strong span a u div section center font svg math".split())
#: What an opening tag closes when it is still open.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s>/]*+)((?:\"[^\"<]*+\"|'[^'<]*+'|[^'\">])*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s>/]*+)([^>]*+)>")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

PATH, WORDS, NUMBERS = 192, 32, 13
WIDTH, HIDDEN = PATH + WORDS + NUMBERS, 20


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: float  # share of the characters inside links
    boxes: tuple[int, ...] = ()  # the block elements that it lies in, outermost first


def cut(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []
    parts: list[str] = []
    links = linked = pos = boxes = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(x for _, x, _ in stack), text, min(1.0, linked / len(text)), tuple(n for _, _, n in stack if n)))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text) if links else 0

    n = len(page)
    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            add(page[pos:])
            break
        if at > pos:
            add(page[pos:at])
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            pos = n if end < 0 else end + 1
            continue
        m = TAG.match(page, at) or LOOSE.match(page, at)
        if not m:
            if page[at + 1 : at + 2].isalpha() or page.startswith("</", at):
                break  # a tag that never ends
            add("<")
            pos = at + 1
            continue
        pos, tag = m.end(), m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if tag == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(t in BLOCKS for t, *_ in stack[k:]):
                        flush()
                    del stack[k:]
                    break
            continue
        if m[3].endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        if tag in BLOCKS:
            flush()
            links = 0
            closing = (*CLOSES.get(tag, ()), "p")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closing:
                    del stack[k:]
                    if tag not in CLOSES:
                        break
                elif stack[k][0] in BLOCKS and stack[k][0] not in ("td", "th"):
                    break
        if tag == "br":
            parts.append(" ")
        if tag not in VOID:
            links += tag == "a"
            names = " ".join(x for g in NAMES.findall(m[3]) for x in g if x).lower() if m[3] else ""
            boxes += 1
            stack.append((tag, f"{tag} {names}" if names else tag, boxes if tag in BLOCKS else 0))
    flush()
    return out


@lru_cache(maxsize=1)
def known_names() -> frozenset[str]:
    """First four letters of the names that training pages have."""
    lists = " ".join([*MAIN, *OTHER, *PLAIN, *FOREIGN_MAIN, *FOREIGN_OTHER])
    return frozenset(w[:4] for w in re.findall(r"[a-z]+", lists))


@lru_cache(maxsize=50_000)
def path_cells(path: tuple[str, ...]) -> np.ndarray:
    """Hashed tag path, whole: tags, the innermost ones by place, trigrams of class and id words that begin like a known one.

    Other words were never learned from, so they would only be noise.
    Every step counts once however deep it lies, so wrappers around a container change nothing.
    """
    v = np.zeros(PATH, np.float32)
    seen = set()
    telling = [step for step in path if step.split(" ", 1)[0] not in NEUTRAL]
    for depth, step in enumerate(reversed(telling[-2:])):
        v[zlib.crc32(f"{step.split(' ', 1)[0]}@{depth}".encode()) % PATH] += 0.5
    for step in set(path):
        tag, *names = step.split()
        if tag not in NEUTRAL:
            seen.add(tag)
        for name in re.findall(r"[a-z]+", " ".join(names)):
            if name[:4] not in known_names():
                continue
            marked = f"^{name}$"
            seen.update(marked[k : k + 3] for k in range(max(1, len(marked) - 2)))
    for mark in sorted(seen):
        v[zlib.crc32(mark.encode()) % PATH] += 0.5 if "^" in mark or "$" in mark or len(mark) == 3 else 1
    return np.minimum(v, 2)


class WordCells(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = cell = zlib.crc32(word.lower().encode()) % WORDS
        return cell


def placing(blocks: list[Block]) -> np.ndarray:
    """How a page's blocks lie together, (blocks, 7): for the outermost container that does not hold nearly all text, and
    for the innermost that holds another block, the share of the page's text and whether there is a heading; whether
    the block before lies in the same ones; and the share of the block's words that are in the page's title."""
    out = np.zeros((len(blocks), 7), np.float32)
    last = [b.path[-1].split(" ", 1)[0] if b.path else "" for b in blocks]
    title = {w for b, t in zip(blocks, last, strict=True) if t == "title" for w in b.text.lower().split()}
    text, held, headed = {}, {}, set()
    for b, t in zip(blocks, last, strict=True):
        for box in b.boxes if t != "title" else ():
            text[box] = text.get(box, 0) + len(b.text)
            held[box] = held.get(box, 0) + 1
            if t in ("h1", "h2"):
                headed.add(box)
    whole = max(1, sum(len(b.text) for b, t in zip(blocks, last, strict=True) if t != "title"))
    before = (-1, -1)
    for i, b in enumerate(blocks):
        outer = next((x for x in b.boxes if text.get(x, 0) < 0.95 * whole), 0)
        inner = next((x for x in reversed(b.boxes) if held.get(x, 0) > 1), 0)
        words = b.text.lower().split() if title and len(b.text) < 1000 else []
        out[i] = (text.get(outer, 0) / whole, outer in headed, text.get(inner, 0) / whole, inner in headed, outer == before[0], inner == before[1], sum(w in title for w in words) / max(1, len(words)))
        before = (outer, inner)
    return out


def vectors(blocks: list[Block], cells: WordCells) -> np.ndarray:
    """Features of a page's blocks."""
    x = np.zeros((len(blocks), WIDTH), np.float32)
    words = [b.text.split() for b in blocks]
    sizes = np.array([len(w) for w in words], np.int64)
    found = np.fromiter((cells[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
    np.add.at(x, (np.repeat(np.arange(len(blocks)), sizes), PATH + found), 1)
    x[:, PATH : PATH + WORDS] /= np.sqrt(np.maximum(sizes, 1))[:, None] * 2
    for i, b in enumerate(blocks):
        x[i, :PATH] = path_cells(b.path)
        x[i, PATH + WORDS : PATH + WORDS + 6] = (np.log1p(len(b.text)) / 6, np.log1p(sizes[i]) / 5, b.linked, b.text[-1] in ".!?", sizes[i] < 4, "©" in b.text)
    x[:, PATH + WORDS + 6 :] = placing(blocks)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(z: np.ndarray, w: np.ndarray, order: np.ndarray, live: list[int], keep: bool = False):
    """Hidden states of all blocks; z: input projections (blocks, 4 hidden), order: block of (step, page)."""
    h = np.zeros((order.shape[1], HIDDEN))
    c = np.zeros_like(h)
    out = np.zeros((len(z), HIDDEN))
    tape = []
    for t, k in enumerate(live):
        at = order[t, :k]
        g = z[at] + h[:k] @ w
        i, f, o = (_sigmoid(g[:, n * HIDDEN : (n + 1) * HIDDEN]) for n in range(3))
        u = np.tanh(g[:, 3 * HIDDEN :])
        before, hb = c[:k].copy(), h[:k].copy()
        c[:k] = f * before + i * u
        tc = np.tanh(c[:k])
        h[:k] = o * tc
        out[at] = h[:k]
        if keep:
            tape.append((at, k, i, f, o, u, before, hb, tc))
    return out, tape


def lstm_back(grad: np.ndarray, w: np.ndarray, tape: list, shape: tuple) -> tuple[np.ndarray, np.ndarray]:
    dz, dw = np.zeros(shape), np.zeros_like(w)
    pages = max((k for _, k, *_ in tape), default=0)
    dh, dc = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    for at, k, i, f, o, u, before, hb, tc in reversed(tape):
        d = dh[:k] + grad[at]
        e = dc[:k] + d * o * (1 - tc**2)
        g = np.concatenate([e * u * i * (1 - i), e * before * f * (1 - f), d * tc * o * (1 - o), e * i * (1 - u**2)], axis=1)
        dz[at] = g
        dw += hb.T @ g
        dh[:k] = g @ w.T
        dc[:k] = e * f
    return dz, dw


def steps(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(forward, backward): the block of (step, page), longest page first; pages with that many blocks."""
    length = np.diff(breaks)
    by = np.argsort(-length, kind="stable")
    first, length = breaks[:-1][by], length[by]
    t = np.arange(int(length[0]) if len(length) else 0)[:, None]
    live = [int(k) for k in np.searchsorted(-length, -t[:, 0], side="left")]
    return first + np.minimum(t, length - 1), first + np.maximum(length - 1 - t, 0), live


class Labeller(NamedTuple):
    w_in: np.ndarray  # (2, WIDTH + 1, 4 hidden)
    w_rec: np.ndarray  # (2, hidden, 4 hidden)
    w_out: np.ndarray  # (2 hidden + 1,)


def label(x: np.ndarray, breaks: np.ndarray, model: Labeller) -> np.ndarray:
    """The probability that each block is main text."""
    ahead, back, live = steps(breaks)
    both = [lstm(x @ model.w_in[d, :-1] + model.w_in[d, -1], model.w_rec[d], order, live)[0] for d, order in ((0, ahead), (1, back))]
    return _sigmoid(np.concatenate(both, axis=1) @ model.w_out[:-1] + model.w_out[-1])


#: Fixed values for generated pages: containers of main text, containers of everything else, and words that the latter tend to hold.
MAIN = ["article", "main", "article class='post'", "main id='content'", "div class='content'", "div id='article-body'", "section class='entry-content'", "div class='post-content'", "div class='story'", "div role='main'", "div class='text'", "div", "div", "section"]
OTHER = [
    "nav", "header", "footer", "aside", "form", "div class='menu'", "div class='navbar'", "div id='header'", "div class='site-header'", "div class='footer'", "div id='footer-links'", "div class='sidebar'", "aside class='widget'", "div class='ad'",
    "div class='ads banner'", "div class='advert'", "div class='sponsored'", "div class='promo'", "div class='cookie-notice'", "div id='cookie-banner'", "div class='notice'", "div class='alert'", "div class='newsletter'", "div class='subscribe'",
    "section class='comments'", "div id='comments'", "div class='comment-list'", "div class='comment'", "ol class='commentlist'", "div class='related'", "ul class='share'", "div class='social'", "div class='breadcrumbs'", "div class='login form'", "div class='popup'", "div class='copyright'", "div class='pagination'", "div class='search'", "div class='reader-comments'", "div class='consent'",
]
TYPICAL = "home about contact login menu search cookie cookies accept privacy terms subscribe newsletter share reply comment comments copyright rights reserved related sponsored advertisement email password submit next previous".split()
#: What the same containers are called in other languages.
FOREIGN_MAIN = "inhalt artikel beitrag contenu contenido articulo entrada contenuto articolo conteudo artigo texte cuerpo corpo tekst innehall".split()
FOREIGN_OTHER = "werbung anzeige kommentare kopf fuss fusszeile leiste pub publicite commentaires pied entete publicidad comentarios cabecera pie barra pubblicita commenti testata publicidade rodape reclame reacties kommentarer suche buscar recherche impressum".split()
#: Names that say nothing, around anything.
PLAIN = ["div", "div", "div", "section", "div class='wrapper'", "div id='page'", "div class='container'", "div class='row'", "div class='inner'", "div class='col'", "div id='root'", "center"]


def training_pages(n: int, seed: int = 7, odd: float = 0.0) -> Iterator[tuple[str, set[str]]]:
    """Generated pages and the set of their main blocks' texts.

    ``odd`` is the share of pages that are harder to read: foreign, cut or meaningless names, links in the main text, odd signs, comments in rows.
    """
    rnd = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er", "is", "on")]
    marks: list[str] = [""]

    def word() -> str:
        return "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) + rnd.choice(marks)

    def wrapped(inner: str, levels: int) -> str:
        for _ in range(levels):
            kind = rnd.choice(PLAIN)
            inner = f"<{kind}>{inner}</{kind.split()[0]}>"
        return inner

    def depth() -> int:
        return rnd.choice([0, 0, 0, 0, 1, 1, 2, 3, 5, 8, 20])

    for _ in range(n):
        main: set[str] = set()
        strange = rnd.random() < odd
        marks[:] = [""] if not strange else rnd.choice([[""], [""], ["", "", "é", "ña", "ü"], ["", "###", "%%%", "***", "&amp;", "$$$"]])

        def sentence(low: int, high: int, typical: float = 0.0) -> str:
            said = [rnd.choice(TYPICAL) if rnd.random() < typical else word() for _ in range(rnd.randint(low, high))]
            return " ".join(said).capitalize() + rnd.choice([".", ".", ".", "!", "?", ""])

        def prose(low: int, high: int) -> str:
            return " ".join(sentence(3, 15) for _ in range(rnd.randint(low, high) * (rnd.choice([1, 1, 1, 1, 4]) if strange else 1)))

        def named(kind: str, foreign: list[str]) -> str:
            """The container under its own name, a foreign one, a cut one, or one that says nothing."""
            if meaningless:
                return f"{rnd.choice(['div', 'div', 'div', 'section'])} {rnd.choice(['class', 'id'])}='{rnd.choice('bdfgkpqvxz') + re.sub("[^a-z]", "", word())[: rnd.randint(1, 5)]}'"
            if strange and rnd.random() < 0.2:
                return f"div {rnd.choice(['class', 'id'])}='{rnd.choice(foreign)}'"
            name = re.search(r"='([^']+)'", kind)
            if name is None or not strange or rnd.random() < 0.6:
                return kind
            if rnd.random() < 0.5:
                return kind.replace(name[1], rnd.choice(foreign))
            return kind.replace(name[1], re.split(r"[- ]", name[1])[-1][: rnd.randint(4, 6)])

        def linked(said: str) -> str:
            """With a link around some of its words, or all of them."""
            ws = said.split()
            a = rnd.randrange(len(ws))
            b = len(ws) if rnd.random() < 0.2 else min(len(ws), a + rnd.randint(1, 4))
            a = 0 if b == len(ws) and rnd.random() < 0.5 else a
            return " ".join([*ws[:a], "<a href='/y'>" + " ".join(ws[a:b]) + "</a>", *ws[b:]])

        def other(kind: str) -> str:
            kind = named(kind, FOREIGN_OTHER)
            tag = kind.split()[0]
            style = rnd.random()
            typical = rnd.choice([0, 0, 0.5])
            if style < 0.3 or tag in ("nav", "ul", "ol"):
                inner = "".join(f"<li><a href='/x'>{sentence(1, 3, typical)}</a></li>" for _ in range(rnd.randint(1, 7)))
                inner = inner if tag in ("ul", "ol") else f"<ul>{inner}</ul>"
            elif style < 0.6 or meaningless and style < 0.75:
                inner = rnd.choice(["", "", "&copy; ", "Copyright "] if strange else ["", "&copy; "]) + sentence(1, 18, typical)
            elif meaningless or strange and style < 0.75:  # comments: who and when, then what
                box = rnd.choice(["div", "p", "li"])
                inner = "".join(f"<{box}>{rnd.choice(['', '<b>' + word().capitalize() + '</b> ', word() + ': '])}{prose(1, 2)}</{box}>" for _ in range(rnd.randint(1, 5)))
            else:
                inner = "".join(wrapped(f"<p>{sentence(2, 40, typical)}</p>", rnd.choice([0, 0, 1])) for _ in range(rnd.randint(1, 4)))
            return wrapped(f"<{kind}>{inner}</{tag}>", rnd.choice([0, 0, 0, depth()]))

        def body() -> str:
            out = []
            bare = rnd.random() < 0.2  # paragraphs as plain div elements
            links = rnd.choice([0, 0, 0.1, 0.5]) if strange else 0
            for k in range(rnd.randint(3 if meaningless else 1, 14)):
                said = sentence(1, 4) if rnd.random() < 0.25 else prose(1, 5)
                tag = "h1" if k == 0 and (meaningless or rnd.random() < 0.7) else "div" if bare else rnd.choice(["p"] * 8 + ["h2", "h3", "li", "blockquote", "td", "pre"])
                said = (title if strange and rnd.random() < 0.6 else sentence(1, 12)) if tag == "h1" else said
                main.add(html.unescape(said))
                inner = linked(said) if tag != "h1" and rnd.random() < links else rnd.choice([said, said, said, said, f"<b>{said}</b>", f"<b>{said}<br>", f"<span>{said}</span>"])
                inner = {"li": f"<ul><li>{inner}</li></ul>", "td": f"<table><tr><td>{inner}</td></tr></table>"}.get(tag, f"<{tag}>{inner}" + (f"</{tag}>" if tag == "div" or rnd.random() < 0.9 else ""))
                out.append(wrapped(inner, rnd.choice([0, 0, 0, 0, 0, 1, 2])))
                if not meaningless and rnd.random() < 0.06:
                    out.append(other(rnd.choice(OTHER[5:])))
            return "".join(out)

        meaningless = strange and rnd.random() < 0.45
        title = sentence(2, 12)
        some = lambda low, high: "".join(other(rnd.choice(OTHER)) for _ in range(rnd.randint(low, high)))
        kind = named(rnd.choice(MAIN[:1] * 4 + MAIN), FOREIGN_MAIN)
        nothing = strange and rnd.random() < 0.06  # nothing but menus and the like
        core = rnd.choice(["".join(other(rnd.choice(OTHER)) for _ in range(rnd.choice([0, 1, 5, 30]))), f"<{(k := rnd.choice(OTHER))}>{word()}</{k.split()[0]}>" * rnd.randint(2, 150)]) if nothing else wrapped(f"<{kind}>{body()}</{kind.split()[0]}>", depth())
        page = wrapped(some(0, 3) + core + some(0, 3), depth())
        head = title if not strange else rnd.choice([title, title, title[: rnd.randint(5, 60)], f"{title} - {word()}", sentence(2, 12), ""])
        yield f"<html><head><title>{head}</title></head><body>{some(0, 2)}{page}{some(0, 2)}</body></html>", main


@lru_cache(maxsize=1)
def trained(pages: int = 2400, epochs: int = 7, batch: int = 50, seed: int = 3) -> Labeller:
    """Train on generated pages by Adam; the same result every time."""
    cells, rnd = WordCells(), np.random.default_rng(seed)
    xs, ys = [], []
    for page, main in training_pages(pages, odd=0.7):
        blocks = cut(page)
        xs.append(vectors(blocks, cells).astype(np.float64))
        ys.append(np.array([b.text in main and b.path[-1] != "title" for b in blocks], float))
    theta = [rnd.normal(0, 0.15, (2, WIDTH + 1, 4 * HIDDEN)), rnd.normal(0, 0.15, (2, HIDDEN, 4 * HIDDEN)), rnd.normal(0, 0.3, 2 * HIDDEN + 1)]
    theta[0][:, -1, HIDDEN : 2 * HIDDEN] = 1  # remember at first
    m, v, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    mean, many = [np.zeros_like(t) for t in theta], 0  # of the weights in the second half, which is steadier than the last ones
    for _ in range(epochs):
        for chosen in np.array_split(rnd.permutation(pages), pages // batch):
            x, y = np.concatenate([xs[i] for i in chosen]), np.concatenate([ys[i] for i in chosen])
            ahead, back, live = steps(np.cumsum([0] + [len(ys[i]) for i in chosen]))
            hidden, tapes = [], []
            for d, order in ((0, ahead), (1, back)):
                h, tape = lstm(x @ theta[0][d, :-1] + theta[0][d, -1], theta[1][d], order, live, keep=True)
                hidden.append(h)
                tapes.append(tape)
            h = np.concatenate(hidden, axis=1)
            err = (_sigmoid(h @ theta[2][:-1] + theta[2][-1]) - y) / len(y)
            grads = [np.zeros_like(theta[0]), np.zeros_like(theta[1]), np.concatenate([h.T @ err, [err.sum()]])]
            for d in (0, 1):
                part = err[:, None] * theta[2][d * HIDDEN : (d + 1) * HIDDEN]
                dz, grads[1][d] = lstm_back(part, theta[1][d], tapes[d], (len(x), 4 * HIDDEN))
                grads[0][d, :-1], grads[0][d, -1] = x.T @ dz, dz.sum(axis=0)
            step += 1
            rate = 0.02 * (1 - 0.95 * step / (epochs * (pages // batch)))
            large = max(1.0, float(np.sqrt(sum((g**2).sum() for g in grads))) / 0.5)
            for k, g in enumerate(grads):
                g = g / large + 1e-5 * theta[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                theta[k] = theta[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if step * 2 > epochs * (pages // batch):
                mean, many = [a + t for a, t in zip(mean, theta, strict=True)], many + 1
    return Labeller(*((a / many).astype(np.float32) for a in mean))


def kept(spark: SparkSession) -> Labeller:
    """The trained labeller; its weights stay in the warehouse folder for later sessions of the same module."""
    import inspect
    import sys

    mark = hashlib.sha256(inspect.getsource(sys.modules[__name__]).encode()).hexdigest()[:24]
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark-models/main-text-{mark}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        row = spark.read.schema("weights binary").parquet(path).first()
        flat = np.frombuffer(row.weights, np.float32)
        a, b = 2 * (WIDTH + 1) * 4 * HIDDEN, 2 * HIDDEN * 4 * HIDDEN
        return Labeller(flat[:a].reshape(2, WIDTH + 1, 4 * HIDDEN), flat[a : a + b].reshape(2, HIDDEN, 4 * HIDDEN), flat[a + b :])
    model = trained()
    weights = np.concatenate([w.reshape(-1) for w in model]).astype(np.float32).tobytes()
    spark.createDataFrame([(bytearray(weights),)], "weights binary").coalesce(1).write.mode("overwrite").parquet(path)
    return model


def extract_pages(pages: list[str], model: Labeller, cells: WordCells) -> list[str]:
    cuts = [cut(p) for p in pages]
    full = [c for c in cuts if c]
    if not full:
        return [""] * len(pages)
    breaks = np.cumsum([0] + [len(c) for c in full])
    main = label(np.concatenate([vectors(c, cells) for c in full]), breaks, model) >= 0.5
    texts = iter("\n".join(b.text for b, keep in zip(c, main[s:], strict=False) if keep) for c, s in zip(full, breaks[:-1], strict=True))
    return [next(texts) if c else "" for c in cuts]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or kept(spark))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = WordCells()
        for b in batches(rows):
            texts = extract_pages(texts_of(b.column(2)), shared.value, cells)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
