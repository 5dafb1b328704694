"""Main text of web pages by a recurrent block labeller.

A page is parsed to its leaf blocks: runs of text between boundaries of block elements. Each block has a vector of
its hashed tag path (tags, classes, ids, roles), its hashed words and a few numbers. A bidirectional LSTM in numpy reads
the page's blocks in order and labels every one with the whole page as context. It is trained on pages that a seeded
generator builds from invented words, in many layouts, where each block's label is known.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_map, sized, table

PATH_DIMS, LEAF_DIMS, WORD_DIMS, NUMBERS = 48, 32, 24, 10
DIMS = PATH_DIMS + LEAF_DIMS + WORD_DIMS + NUMBERS
HIDDEN, TRAINED, EPOCHS, BATCH, RATE = 24, 1500, 6, 32, 0.01
#: Blocks that are labelled at a time.
AT_ONCE = 8192

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content runs to their end tag, or to the page's end without one, and is no text of the page.
RAW = frozenset("script style textarea title iframe".split())
#: Elements whose text is no text of the page, whatever stands in them; the loose ones end where one of the third kind starts.
SILENT = frozenset("noscript template svg select option optgroup datalist".split())
LOOSE = frozenset("svg select option optgroup datalist".split())
BREAKING = frozenset("address article aside blockquote center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
INLINE = frozenset("a abbr acronym b bdi bdo big canvas cite code data dfn del em font i img ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br button input".split())
#: What a new element of these ends, and the elements that keep it from doing so.
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("optgroup", "option")}
_BARS = ("ul", "ol", "dl", "table", "tr", "select", "datalist")
_SIMPLE = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:\s++[^\s"'<>/=]++(?:=(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>=`]++))?+)*+)\s*+(/?)>""")
_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)?+(\s*+=\s*+)?+")
_UNQUOTED = re.compile(r"[^\s>]*+")
_NAMED = re.compile(r"""(?<![^\s/"'])(?:class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_PART = re.compile(r"[A-Za-z]+")
_CLOSE = {t: re.compile(rf"</{t}(?![^\s/>])[^>]*+(?:>|\Z)|\Z", re.I) for t in RAW}


class Path:
    """The block elements around a block: equal paths of a page are one object. total sums the features of all its elements."""

    __slots__ = ("parent", "tag", "names", "below", "vector")

    def __init__(self, parent, tag: str, names: tuple[str, ...]):
        self.parent, self.tag, self.names, self.below, self.vector = parent, tag, names, {}, None

    def child(self, tag: str, names: tuple[str, ...]) -> Path:
        found = self.below.get((tag, names))
        if found is None:
            found = self.below[tag, names] = Path(self, tag, names)
        return found


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: Path, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


class _Scanner:
    """Tags of a page. Every character is passed over a bounded number of times: a quote that never closes, and a tag whose quotes hide
    its end, are noticed once for the whole page, and from there on quotes mean nothing."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.closed = {q: page.rfind(q) for q in "\"'"}
        self.quotes = True

    def tag(self, at: int) -> tuple[bool, str, str, bool, int]:
        """(it is an end tag, name, attributes, closed by a slash, where it ends) of the tag at page[at]; ends at -1 if it never does."""
        page = self.page
        if m := _SIMPLE.match(page, at):
            return bool(m[1]), m[2].lower(), m[3], bool(m[4]), m.end()
        end = page.startswith("/", at + 1)
        name = _NAME.match(page, at + 1 + end)
        k = name.end()
        if at > self.last:
            return end, "", "", False, -1
        first = k
        while self.quotes:
            m = _ATTRIBUTE.match(page, k)
            k = m.end()
            if k >= len(page):
                self.quotes = False  # the rest of the page is inside quotes
                break
            if m[2]:
                q = page[k]
                if q in "\"'" and self.closed[q] > k:
                    k = page.index(q, k + 1) + 1
                else:
                    k = _UNQUOTED.match(page, k).end()
            elif page[k] == ">":
                break
        if not self.quotes:
            k = page.find(">", first)
            if k < 0:
                return end, "", "", False, -1
        return end, name[0].lower(), page[first:k], page[k - 1] == "/", k + 1


def blocks(page: str) -> list[Block]:
    """The leaf blocks in page order: references decoded, white space as single spaces, trimmed, none empty. A <br> is white
    space. Malformed markup is read as browsers do: a block start ends an open paragraph, stray ends are passed over. Time and memory
    are in proportion to the page, however deep its elements and long its tags; a tag that never ends is no text, nor is what
    stands in it."""
    out: list[Block] = []
    top = Path(None, "", ())
    stack: list[tuple[str, Path, int]] = []  # open block elements: tag, path, links that were open outside
    places: dict[str, list[int]] = {}  # of each tag, ascending places in the stack
    parts: list[str] = []
    path, scan = top, _Scanner(page)
    links = linked = silent = 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(path, text, linked))
        parts, linked = [], 0

    def drop(i: int) -> None:
        nonlocal links, silent
        while len(stack) > i:
            tag, _, links = stack.pop()
            places[tag].pop()
            silent -= tag in SILENT

    def last(tag: str) -> int:
        found = places.get(tag)
        return found[-1] if found else -1

    while at < size:
        lt = page.find("<", at)
        if lt != at:
            text = page[at:] if lt < 0 else page[at:lt]
            at = size if lt < 0 else lt
        elif (c := page[at + 1 : at + 2]) in ("!", "?") and c:
            if page.startswith("<!--", at):
                end = at + 4 if page.startswith(">", at + 4) else page.find("-->", at + 4) + 2 if page.find("-->", at + 4) >= 0 else -1
            else:
                end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        elif not _NAME.match(page, at + 1 + (c == "/")):
            text, at = "<", at + 1
        else:
            text = None
        if text is not None:
            if not silent:
                if not parts:
                    path = stack[-1][1] if stack else top
                parts.append(entities.unescape(text) if "&" in text else text)
                if links:
                    linked += len(text.strip())
            continue
        is_end, tag, attributes, slash, at = scan.tag(at)
        if at < 0:
            break
        if is_end:
            if tag in INLINE:
                if tag == "a" and links > (stack[-1][2] if stack else 0):
                    links -= 1
            else:
                flush()
                if (i := last(tag)) >= 0:
                    drop(i)
            continue
        if tag in RAW:
            if not slash:
                at = _CLOSE[tag].search(page, at).end()
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag not in INLINE:
                flush()
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        flush()
        if tag in BREAKING and silent:
            i = min((places[t][0] for t in LOOSE if places.get(t)), default=-1)
            if i >= 0:
                drop(i)
        if tag not in SILENT and (i := last("p")) > max(last("noscript"), last("template")):
            drop(i)
        if tag in _SAME:
            i = max(last(t) for t in _SAME[tag])
            if i > max(last(t) for t in _BARS if t != tag):
                drop(i)
        names = tuple(w.lower() for a in _NAMED.findall(attributes) for w in _PART.findall(" ".join(a))) if attributes else ()
        if slash and tag in LOOSE:
            continue
        stack.append((tag, (stack[-1][1] if stack else top).child(tag, names), links))
        places.setdefault(tag, []).append(len(stack) - 1)
        silent += tag in SILENT
    flush()
    return out


@functools.lru_cache(200_000)
def _place(what: str, dims: int) -> tuple[int, float]:
    h = zlib.crc32(what.encode())
    return h % dims, 1.0 if h >> 16 & 1 else -1.0


class _Words(dict):
    """A word's place: below WORD_DIMS it adds there, from there on it subtracts. Bounded."""

    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        i, s = _place(w, WORD_DIMS)
        self[w] = i if s > 0 else i + WORD_DIMS
        return self[w]


_WORDS = _Words()


@functools.lru_cache(50_000)
def _features(tag: str, names: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIMS, np.float32)
    for what in {tag, *("." + n for n in names)}:
        i, s = _place(what, PATH_DIMS)
        v[i] += s
    return v


def _total(path: Path) -> np.ndarray:
    """The sum of the features of the path's elements."""
    todo = []
    while path.vector is None and path.parent is not None:
        todo.append(path)
        path = path.parent
    if path.vector is None:
        path.vector = np.zeros(PATH_DIMS, np.float32)
    for p in reversed(todo):
        p.vector = p.parent.vector + _features(p.tag, p.names)
    return todo[0].vector if todo else path.vector


def _path_vector(path: Path) -> np.ndarray:
    v = np.zeros(PATH_DIMS + LEAF_DIMS, np.float32)
    v[:PATH_DIMS] = _total(path)
    for depth in range(2):
        if path.parent is None:
            break
        for what in {path.tag, *("." + n for n in path.names)}:
            i, s = _place(f"{depth}{what}", LEAF_DIMS)
            v[PATH_DIMS + i] += s
        path = path.parent
    return np.clip(v, -3, 3)


def vectors(page: list[Block]) -> np.ndarray:
    n = len(page)
    if not n:
        return np.zeros((0, DIMS), np.float32)
    split = [b.text.lower().split() for b in page]
    count = [len(w) for w in split]
    place = np.array([_WORDS[w] for words in split for w in words], np.int64)
    signed = np.bincount(np.repeat(np.arange(n), count) * (2 * WORD_DIMS) + place, minlength=n * 2 * WORD_DIMS).reshape(n, 2, WORD_DIMS)
    bag = (signed[:, 0] - signed[:, 1]).astype(np.float32)
    bag /= np.maximum(1, np.sqrt((bag * bag).sum(axis=1)))[:, None]
    numbers = [
        (
            min(math.log1p(len(b.text)) / 5, 2), min(math.log1p(c) / 4, 2), min(1.0, b.linked / len(b.text)), min(1.0, sum(map(b.text.count, ".!?;,")) / c),
            b.text[-1] in ".!?:;\"”", sum(map(b.text.count, "0123456789")) / len(b.text), k / n, min(n, 100) / 100, k > 0 and page[k - 1].path is b.path, "©" in b.text,
        )
        for k, (b, c) in enumerate(zip(page, count, strict=True))
    ]
    found: dict[int, np.ndarray] = {}
    for b in page:
        if id(b.path) not in found:
            found[id(b.path)] = _path_vector(b.path)
    return np.hstack([np.array([found[id(b.path)] for b in page]), bag, np.array(numbers, np.float32)])


# ---------------------------------------------------------------- the network

def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _start(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["x" + d] = r.standard_normal((DIMS, 4 * HIDDEN)).astype(np.float32) / DIMS**0.5
        p["h" + d] = r.standard_normal((HIDDEN, 4 * HIDDEN)).astype(np.float32) / HIDDEN**0.5
        p["c" + d] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)  # gates: in, forget, out, cell
    p["w"] = r.standard_normal((2 * HIDDEN, 1)).astype(np.float32) / HIDDEN**0.5
    p["s"] = r.standard_normal((DIMS, 1)).astype(np.float32) / DIMS
    p["b"] = np.zeros(1, np.float32)
    return p


def _lstm(x: np.ndarray, p: dict, d: str):
    """x (T, B, DIMS) -> h (T, B, HIDDEN) and what the way back needs."""
    steps, batch = x.shape[:2]
    a = x @ p["x" + d] + p["c" + d]
    h, c = np.zeros((steps + 1, batch, HIDDEN), np.float32), np.zeros((steps + 1, batch, HIDDEN), np.float32)
    gates = np.zeros((steps, batch, 4 * HIDDEN), np.float32)
    k = HIDDEN
    for t in range(steps):
        z = a[t] + h[t] @ p["h" + d]
        g = gates[t]
        g[:, : 3 * k] = _sigmoid(z[:, : 3 * k])
        g[:, 3 * k :] = np.tanh(z[:, 3 * k :])
        c[t + 1] = g[:, k : 2 * k] * c[t] + g[:, :k] * g[:, 3 * k :]
        h[t + 1] = g[:, 2 * k : 3 * k] * np.tanh(c[t + 1])
    return h[1:], (h, c, gates)


def _lstm_back(x, dh, kept, p, d) -> dict[str, np.ndarray]:
    h, c, gates = kept
    k, steps = HIDDEN, len(x)
    dz = np.zeros_like(gates)
    nh, nc = np.zeros_like(h[0]), np.zeros_like(c[0])
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (gates[t][:, j * k : (j + 1) * k] for j in range(4))
        tc = np.tanh(c[t + 1])
        gh = dh[t] + nh
        gc = nc + gh * o * (1 - tc * tc)
        z = dz[t]
        z[:, :k], z[:, k : 2 * k], z[:, 2 * k : 3 * k], z[:, 3 * k :] = gc * g * i * (1 - i), gc * c[t] * f * (1 - f), gh * tc * o * (1 - o), gc * i * (1 - g * g)
        nc = gc * f
        nh = z @ p["h" + d].T
    flat = dz.reshape(-1, 4 * k)
    return {"x" + d: x.reshape(-1, x.shape[2]).T @ flat, "h" + d: h[:-1].reshape(-1, k).T @ flat, "c" + d: flat.sum(axis=0)}


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(T, B, DIMS), lengths, and the index that turns each page round in its own length."""
    n = np.array([len(x) for x in pages])
    x = np.zeros((n.max(), len(pages), DIMS), np.float32)
    for j, page in enumerate(pages):
        x[: n[j], j] = page
    t = np.arange(n.max())[:, None]
    return x, n, np.where(t < n, n - 1 - t, t)


def _forward(x, back, p):
    cols = np.arange(x.shape[1])
    hf, kf = _lstm(x, p, "f")
    xr = x[back, cols]
    hr, kr = _lstm(xr, p, "b")
    both = np.concatenate([hf, hr[back, cols]], axis=2)
    return _sigmoid(both @ p["w"] + x @ p["s"] + p["b"])[..., 0], (both, kf, kr, xr)


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Adam on the log loss of every block of every page; pages of like length share a batch."""
    p = _start()
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    r = random.Random(3)
    pages = sorted(pages, key=lambda x: len(x[0]))
    batches = [pages[i : i + BATCH] for i in range(0, len(pages), BATCH)]
    for _ in range(epochs):
        r.shuffle(batches)
        for batch in batches:
            x, n, back = _padded([b[0] for b in batch])
            y = np.zeros(x.shape[:2], np.float32)
            for j, (_, labels) in enumerate(batch):
                y[: n[j], j] = labels
            out, (both, kf, kr, xr) = _forward(x, back, p)
            dz = ((out - y) * (np.arange(len(x))[:, None] < n) / n.sum())[..., None].astype(np.float32)
            g = {"w": both.reshape(-1, 2 * HIDDEN).T @ dz.reshape(-1, 1), "s": x.reshape(-1, DIMS).T @ dz.reshape(-1, 1), "b": dz.sum(axis=(0, 1))}
            dh = dz @ p["w"].T
            g |= _lstm_back(x, dh[..., :HIDDEN], kf, p, "f")
            g |= _lstm_back(xr, dh[..., HIDDEN:][back, np.arange(x.shape[1])], kr, p, "b")
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {k: x.astype(np.float32) for k, x in p.items()}


def label(pages: list[np.ndarray], p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The chance of each block of each page to be main text."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(pages[order[to]]) <= AT_ONCE:
            to += 1
        x, n, back = _padded([pages[i] for i in order[at:to]])
        found = _forward(x, back, p)[0]
        for j, i in enumerate(order[at:to]):
            out[i] = found[: n[j], j]
        at = to
    return out


# ---------------------------------------------------------------- pages to learn from

#: Names that layouts give their parts. Fixed lists; every page draws its own mixture.
NAMES = {
    "article": "article content post entry story main-content article-body post-content entry-content text body-text main page-content".split(),
    "header": "header site-header masthead topbar banner branding page-header top logo hero".split(),
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs main-menu links pagination pager tabs toc skip".split(),
    "ad": "ad ads advert advertisement promo sponsor sponsored banner-ad adsbox ad-slot marketing teaser".split(),
    "notice": "cookie cookie-notice notice consent gdpr alert privacy popup modal message paywall subscribe-notice".split(),
    "sidebar": "sidebar aside widget related recommended side rail popular more-stories secondary tags archive author-box".split(),
    "comments": "comments comment comment-list discussion respond reactions replies disqus user-comments thread".split(),
    "form": "form search newsletter signup login subscribe contact-form search-form".split(),
    "share": "share social share-buttons toolbar meta byline actions print".split(),
    "footer": "footer site-footer colophon copyright bottom legal foot credits".split(),
}
_BOILER = "home about contact login share reply like cookies accept privacy terms subscribe newsletter search menu more read next previous copyright rights reserved posted comment comments advertisement sponsored sign email follow us related".split()


def generated_pages(n: int, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """(html, label of each leaf block) of n pages in random layouts with invented words."""
    r = random.Random(seed)
    return [_page(r) for _ in range(n)]


def _page(r: random.Random) -> tuple[str, list[bool]]:
    out, labels = ["<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t='</p>';</script></head><body>"], []
    sounds = [r.choice("bcdfghjklmnprstvwzßñ") + r.choice(["a", "e", "i", "o", "u", "ä", "é", "en", "er", "an", "st"]) for _ in range(14)]
    noisy = r.random() < 0.1

    def word() -> str:
        w = "".join(r.choice(sounds) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))
        return w + r.choice(("***", "###", "%%%", "&amp;&amp;", "!!")) if noisy else w

    def words(a: int, b: int) -> str:
        return " ".join(r.choice(_BOILER) if boiler and r.random() < 0.35 else word() for _ in range(r.randint(a, b)))

    def sentence() -> str:
        return words(1, 14).capitalize() + r.choice((".", ".", ".", "!", "?", ""))

    def paragraph() -> str:
        if r.random() < 0.03:
            return " ".join([word()] * r.randint(5, 300))
        return " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5, 8))))

    boiler = False

    def put(tag: str, text: str, good: bool) -> None:
        labels.append(good)
        style = r.random()
        if tag == "p" and style < 0.1:
            text = f"<b>{text}" if style < 0.05 else f"<b>{text}<br>"
            out.append(f"<p>{text}")
        elif tag in ("p", "li") and style < 0.2:
            out.append(f"<{tag}>{text[: len(text) // 2]}" + f" <a href='/x'>{word()}</a> <em>{word()}</em> {word()}</{tag}>")
        else:
            out.append(f"<{tag}>{text}</{tag}>" if tag not in ("p", "li") or r.random() < 0.85 else f"<{tag}>{text}")

    def named(kind: str, tags: tuple[str, ...]) -> str:
        tag, names = r.choice(tags), ""
        if tag in ("div", "section", "ul", "ol", "span") or r.random() < 0.4:
            name = r.choice(NAMES[kind])
            if r.random() < 0.3:
                name += " " + r.choice((word() if not noisy else "x", "clearfix", "row", "wide", "col"))
            names = r.choice((f' class="{name}"', f" class='{name}'", f' id="{name.split()[0]}"', f' class="{name}" id="{r.choice("abcxyz")}"'))
            if r.random() < 0.1:
                names += f' role="{kind}"'
        out.append(f"<{tag}{names}>")
        return f"</{tag}>"

    def link_list(kind: str, tags: tuple[str, ...]) -> None:
        end, style, n = named(kind, tags), r.random(), r.randint(2, 10)
        if style < 0.7:
            out.append("<ul>")
            for _ in range(n):
                labels.append(False)
                out.append(f'<li><a href="/{word()}">{words(1, 4)}</a></li>')
            out.append("</ul>")
        elif style < 0.85:
            labels.append(False)
            out.append(" | ".join(f'<a href="#">{words(1, 2)}</a>' for _ in range(n)))
        else:
            for _ in range(n):
                labels.append(False)
                out.append(f'<div><a href="/x">{words(1, 6)}</a></div>')
        out.append(end)

    def bad(kind: str, tags: tuple[str, ...], many: int) -> None:
        nonlocal boiler
        boiler = r.random() < 0.6
        if kind in ("nav", "share") or kind in ("header", "footer", "sidebar") and r.random() < 0.4:
            link_list(kind, tags)
        else:
            end = named(kind, tags)
            if kind == "comments":
                if r.random() < 0.7:
                    put(r.choice(("h2", "h3")), words(1, 3), False)
                wrap = r.choice(("div", "li", "article"))
                for _ in range(r.randint(1, 6)):
                    inner = f' class="{r.choice(("comment", "reply", "comment-body"))}"' if r.random() < 0.6 else ""
                    out.append(f"<{wrap}{inner}>")
                    if r.random() < 0.7:
                        put(r.choice(("div", "h4", "p")), words(1, 3), False)
                    boiler = False
                    for _ in range(r.randint(1, 3)):
                        put("p", paragraph(), False)
                    out.append(f"</{wrap}>")
            elif kind == "form":
                out.append("<form action='/s'>")
                for _ in range(r.randint(1, 4)):
                    put(r.choice(("div", "p")), f"<label>{words(1, 4)}</label><input type='text'><button>{word()}</button>", False)
                out.append("</form>")
            elif r.random() < 0.3:
                labels.append(False)
                out.append(("&copy; " if kind == "footer" and r.random() < 0.6 else "") + (paragraph() if r.random() < 0.7 else words(2, 8)))
            else:
                for _ in range(r.randint(1, many)):
                    put(r.choice(("p", "div", "p", "h3", "h2")), ("&copy; " if kind == "footer" and r.random() < 0.3 else "") + (paragraph() if r.random() < 0.6 else words(1, 8)), False)
            out.append(end)
        boiler = False

    if r.random() < 0.2:
        bad("notice", ("div", "section", "aside"), 2)
    if r.random() < 0.4:
        bad("header", ("header", "div"), 2)
    if r.random() < 0.8:
        bad("nav", ("nav", "nav", "div", "ul"), 3)
    if r.random() < 0.3:
        out.append("<!-- ad -->")
    for kind, chance in (("ad", 0.45), ("notice", 0.15), ("form", 0.15), ("sidebar", 0.25)):
        if r.random() < chance:
            bad(kind, {"form": ("div", "section", "form"), "sidebar": ("aside", "div")}.get(kind, ("div", "div", "aside", "section")), 2)
    ends = []
    for _ in range(r.choice((0, 0, 1, 2))):
        out.append(f'<div class="{r.choice(("wrapper", "container", "row", "page", "wrap", "grid", word() if not noisy else "q"))}">')
        ends.append("</div>")
    if r.random() < 0.94:
        ends.append(named("article", ("article", "article", "main", "div", "section")))
    if r.random() < 0.8:
        put(r.choice(("h1", "h1", "h2")), words(1, 12).capitalize(), True)
    if r.random() < 0.15:
        bad("share", ("div", "ul"), 2)
    for _ in range(r.choice((1, 2, 3, 5, 8, 12, 20, 30))):
        style = r.random()
        if style < 0.76:
            put("p", paragraph() if r.random() < 0.85 else words(1, 3).capitalize() + ".", True)
        elif style < 0.82:
            put(r.choice(("h2", "h3", "blockquote", "pre")), words(1, 10).capitalize(), True)
        elif style < 0.88:
            kind = r.choice(("ul", "ol"))
            out.append(f"<{kind}>")
            for _ in range(r.randint(2, 6)):
                put("li", words(1, 12), True)
            out.append(f"</{kind}>")
        elif style < 0.91:
            out.append("<table>")
            for _ in range(r.randint(2, 4)):
                out.append("<tr>")
                for _ in range(3):
                    put("td", words(1, 3), True)
                out.append("</tr>")
            out.append("</table>")
        elif style < 0.95:
            put("div", paragraph(), True)
        elif style < 0.98:
            bad("ad", ("div", "aside"), 2)
        else:
            bad("sidebar", ("div", "aside"), 2)
    out += reversed(ends)
    for kind, chance in (("share", 0.15), ("sidebar", 0.3), ("ad", 0.2), ("comments", 0.4), ("form", 0.25), ("notice", 0.1), ("nav", 0.15), ("footer", 0.8)):
        if r.random() < chance:
            tags = {"sidebar": ("aside", "div"), "comments": ("section", "div", "ol", "div"), "footer": ("footer", "footer", "div"), "nav": ("nav", "div")}.get(kind, ("div", "section"))
            bad(kind, tags, 3)
    return "".join(out) + r.choice(("</body></html>", "")), labels


@functools.cache
def model() -> dict[str, np.ndarray]:
    """Trained once in a driver's life, on TRAINED generated pages; the same seed gives the same weights."""
    learned = []
    for page, labels in generated_pages(TRAINED):
        found = blocks(page)
        if len(found) == len(labels):
            learned.append((vectors(found), np.array(labels, np.float32)))
    return train(learned)


def main_texts(pages: list[str | None], p: dict[str, np.ndarray]) -> list[str]:
    parsed = [blocks(h or "") for h in pages]
    chances = label([vectors(b) for b in parsed], p)
    return ["\n".join([b.text for b, c in zip(found, chance, strict=True) if c >= 0.5]) for found, chance in zip(parsed, chances, strict=True)]


def extract(pages: DataFrame, p: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html). Null and empty html, and pages without main
    text, give an empty text. Rows are read each for itself, repeated ones alike; a very long page is read whole, in time and memory in
    proportion to it. Other columns are left out."""
    shared = pages.sparkSession.sparkContext.broadcast(p or model())

    def run(batches):
        for batch in batches:
            for part in sized(pa.Table.from_batches([batch]), "html", 2_000_000):
                texts = main_texts(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_pydict({"page_id": part.column(0).combine_chunks(), "url": part.column(1).combine_chunks(), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return arrow_map(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
