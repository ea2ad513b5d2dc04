"""Main text of web pages by a recurrent block labeller.

Parsing.  A page is cut into its leaf blocks: the text between block-level tags, with
character references decoded and white space turned into one space.  Scripts, styles, markup,
comments and the head hold no blocks.  A block's path is a node of a tree in which equal paths
share a node, so the time and memory of a page are in proportion to its length, however deep.

Labelling.  Each block becomes a vector: hashed tags, classes and ids of its path, hashed
words, and a few numbers (length, share of link text, place).  A bidirectional LSTM in numpy
reads the vectors of the whole page and gives every block the probability that it belongs to
the article, from what stands before and after it.  Pages of more than LONG blocks are read in
parts by the same recurrence, once forward and once backward, the state carried over, so a page
needs no more memory than its blocks and one part.

Training.  The driver makes TRAIN_PAGES pages from a grammar of page parts (articles in many
containers, menus, headers, footers, sidebars, notices, adverts, forms, comments; well-formed
or not) whose labels are thus known, and trains by Adam.  The words of articles and those of
the other parts are drawn from two distributions, counted in what some sampled pages
(SAMPLE_PAGES, a documented parameter) plainly mark as one or the other; of each, VOCABULARY
words (a documented parameter; those with the smallest hash) with their counts.  The model has
a fixed size; it can be stored and loaded (save_labeller, load_labeller).

Defined results: a null or empty page has the empty text and 0 characters; a page without an
article block too; repeated rows get equal results; an empty table gives no rows; of other
columns those that are asked for are kept, the rest isn't read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

PATH, LEAF, WORDS, NUMBERS, HIDDEN = 160, 32, 48, 6, 24
INPUT = PATH + LEAF + WORDS + NUMBERS
TRAIN_PAGES, EPOCHS, RATE, SEED, SAMPLE_PAGES, VOCABULARY = 1200, 10, 4e-3, 11, 200, 8000
#: Blocks of a page that are read at once, and nodes that a worker keeps between pages.
LONG, KEPT_NODES = 4096, 20_000

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe select option".split())
#: Tags that end an open one of their kind.
SIBLING = frozenset("li dt dd tr td th option".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)|<[!?][^>]*(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME = re.compile(r"[a-z]+|[0-9]+")


def names(attributes: str) -> tuple[str, ...]:
    """Lower-case parts of an element's classes, ids and role."""
    if "=" not in attributes:
        return ()
    return tuple(x for m in ATTRIBUTE.finditer(attributes) for x in NAME.findall((m[2] or m[3] or m[4] or "").lower()))


@lru_cache(maxsize=4096)
def _buckets(tag: str, own: tuple[str, ...]) -> tuple[int, list[int], int]:
    return zlib.crc32(tag.encode()) % PATH, [zlib.crc32(b"." + n.encode()) % PATH for n in own], PATH + zlib.crc32(tag.encode()) % LEAF


class Node:
    """A path of block-level elements: the last one's tag and names, and the path before it."""

    __slots__ = ("parent", "tag", "names", "depth", "below", "_vector")
    made = 0

    def __init__(self, parent: Node | None, tag: str, own: tuple[str, ...]):
        Node.made += 1
        self.parent, self.tag, self.names = parent, tag, own
        self.depth = parent.depth + 1 if parent else 0
        self.below: dict = {}
        self._vector: np.ndarray | None = None

    def child(self, tag: str, own: tuple[str, ...]) -> Node:
        if (found := self.below.get((tag, own))) is None:
            found = self.below[tag, own] = Node(self, tag, own)
        return found

    def vector(self) -> np.ndarray:
        """Which tags and names the path has: 0, 1 or 2 in each bucket; the last tag apart."""
        chain = [self]
        while chain[-1]._vector is None and chain[-1].parent:
            chain.append(chain[-1].parent)
        for node in reversed(chain):
            if node._vector is None:
                v = np.zeros(PATH + LEAF, np.uint8)
                if node.parent:
                    v[:PATH] = node.parent._vector[:PATH]
                    tag, own, leaf = _buckets(node.tag, node.names)
                    v[tag], v[leaf] = max(v[tag], 1), 1
                    for i in own:
                        v[i] = min(v[i] + 1, 2)
                node._vector = v
        return self._vector

    def marks(self) -> set[str]:
        """All tags and names of the path."""
        out, node = set(), self
        while node.parent:
            out |= {node.tag, *node.names}
            node = node.parent
        return out


_ROOT = Node(None, "", ())


def _root() -> Node:
    """The tree's root; a tree that has grown large is left."""
    global _ROOT
    if Node.made > KEPT_NODES:
        Node.made, _ROOT = 0, Node(None, "", ())
    return _ROOT


class Open:
    """An open element; node is None for inline ones, and depth counts the block-level ones before."""

    __slots__ = ("tag", "node", "depth", "alive")

    def __init__(self, tag: str, node: Node | None, depth: int):
        self.tag, self.node, self.depth, self.alive = tag, node, depth, True


def blocks(html: str) -> list[tuple[Node, str, int]]:
    """(path, text, characters inside links) of each leaf block."""
    root = _root()
    out, parts, linked, links = [], [], 0, 0
    stack: list[Open] = []
    solid: list[Open] = []  # the block-level ones of the stack
    by_tag: dict[str, list[Open]] = defaultdict(list)
    at, skip = 0, None

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((solid[-1].node if solid else root, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def end(last: Open) -> None:
        """Closes an element and all that were opened after it."""
        nonlocal links
        while True:
            x = stack.pop()
            if x.alive:
                by_tag[x.tag].pop()
                links -= x.tag == "a"
                if x.node:
                    solid.pop()
            if x is last:
                return

    for m in TOKEN.finditer(html):
        if skip is None and m.start() > at:
            raw = html[at : m.start()]
            parts.append(raw)
            if links:
                linked += len(raw.strip())
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if skip is not None:
            if m[1] and tag == skip:
                skip = None
            continue
        if not m[1] and tag in RAW:
            if not m[3].endswith("/"):
                skip = tag
            continue
        if tag == "br":
            parts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            close()
        if m[1]:
            if by_tag[tag]:
                last = by_tag[tag][-1]
                if inline and last.depth < len(solid):  # misnested: the block goes on
                    by_tag[tag].pop().alive = False
                    links -= tag == "a"
                else:
                    end(last)
        elif tag not in VOID and not m[3].endswith("/"):
            if not inline and solid and (solid[-1].tag == "p" or solid[-1].tag == tag and tag in SIBLING):
                end(solid[-1])  # an open paragraph, list item or cell ends here
            node = None if inline else (solid[-1].node if solid else root).child(tag, names(m[3]))
            stack.append(x := Open(tag, node, len(solid)))
            by_tag[tag].append(x)
            links += tag == "a"
            if node:
                solid.append(x)
    if skip is None and at < len(html):
        parts.append(html[at:])
    close()
    return out


def vectors(found: list[tuple[Node, str, int]], start: int = 0, stop: int | None = None) -> np.ndarray:
    """The vectors of a page's blocks from start to stop."""
    some = found[start:stop]
    out = np.zeros((len(some), INPUT), np.float32)
    for i, (path, text, linked) in enumerate(some):
        own = text.split()
        out[i, : PATH + LEAF] = path.vector()
        n = np.bincount([zlib.crc32(w.encode()) % WORDS for w in own], minlength=WORDS)
        out[i, PATH + LEAF : -NUMBERS] = n / len(own)
        out[i, -NUMBERS:] = (np.log1p(len(text)) / 8, linked / len(text), (start + i) / len(found), min(path.depth, 30) / 10, min(sum(map(text.count, ".,;!?")) / len(own), 1.0), 1)
    return out


class BiLSTM:
    """Both directions share the code; weights lie in one dictionary."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> BiLSTM:
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.1, (INPUT, 4 * HIDDEN))
            w[f"h{d}"] = rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN))
            w[f"c{d}"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
        w["o"], w["p"] = rng.normal(0, 0.1, 2 * HIDDEN), np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, x: np.ndarray, d: str, keep: bool, state: tuple | None = None):
        """Hidden states over steps (T, B, H), what training needs, and the last state; x:
        (T, B, INPUT), padded at the end."""
        steps, batch = x.shape[:2]
        z_in = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = state or (np.zeros((batch, HIDDEN), np.float32),) * 2
        hs, kept = np.zeros((steps, batch, HIDDEN), np.float32), []
        for t in range(steps):
            z = z_in[t] + h @ self.w[f"h{d}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before = c
            c = f * before + i * g
            tc = np.tanh(c)
            if keep:
                kept.append((i, f, o, g, before, tc, h))
            h = o * tc
            hs[t] = h
        return hs, kept, (h, c)

    @staticmethod
    def _flipped(x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each page's own steps in reverse; padding stays at the end."""
        t = np.arange(len(x))[:, None]
        return x[np.where(t < size, size - 1 - t, t), np.arange(x.shape[1])]

    def _forward(self, x: np.ndarray, size: np.ndarray, keep: bool):
        f, kept_f, _ = self._run(x, "f", keep)
        b, kept_b, _ = self._run(self._flipped(x, size), "b", keep)
        both = np.concatenate((f, self._flipped(b, size)), axis=2)
        return 1 / (1 + np.exp(-np.clip(both @ self.w["o"] + self.w["p"], -30, 30))), both, kept_f, kept_b

    def _back(self, x: np.ndarray, d: str, kept: list, dh_all: np.ndarray, grad: dict) -> None:
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        dh = dc = np.zeros(dh_all.shape[1:], np.float32)
        gh = np.zeros_like(self.w[f"h{d}"])
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, before, tc, h_before = kept[t]
            dh = dh + dh_all[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            dz_all[t] = dz
            gh += h_before.T @ dz
            dh, dc = dz @ self.w[f"h{d}"].T, dc * f
        grad[f"h{d}"] = gh
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grad[f"x{d}"], grad[f"c{d}"] = x.reshape(-1, INPUT).T @ flat, flat.sum(axis=0)

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(p) for p in pages])
        x = np.zeros((size.max(), len(pages), INPUT), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k] = p
        return x, size

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator, epochs: int = EPOCHS, rate: float = RATE) -> None:
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, total = 0, epochs * (-(-len(pages) // 16) + -(-len(pages) // 256))
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            near = [sorted(order[k : k + 256], key=lambda j: len(pages[j][1])) for k in range(0, len(order), 256)]
            batches = [part[k : k + 16] for part in near for k in range(0, len(part), 16)]  # of like length
            for k in rng.permutation(len(batches)):
                some = [pages[j] for j in batches[k]]
                x, size = self.padded([p for p, _ in some])
                y = np.zeros(x.shape[:2], np.float32)
                for j, (_, labels) in enumerate(some):
                    y[: len(labels), j] = labels
                real = np.arange(len(x))[:, None] < size
                p, both, kept_f, kept_b = self._forward(x, size, True)
                d = (p - y) * real / real.sum()
                grad = {"o": (both * d[:, :, None]).sum(axis=(0, 1)), "p": d.sum(keepdims=True).reshape(1)}
                dh = d[:, :, None] * self.w["o"]
                self._back(x, "f", kept_f, dh[:, :, :HIDDEN], grad)
                self._back(self._flipped(x, size), "b", kept_b, self._flipped(dh[:, :, HIDDEN:], size), grad)
                step += 1
                now = rate * (1 - step / (total + 1))
                for name, g in grad.items():
                    g = np.clip(g, -1, 1).astype(np.float32)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    self.w[name] -= (now * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def predict(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of each block; pages of like length are read together."""
        out: list = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[0]])
            n = 1
            while n < len(order) and n < 64 and len(pages[order[n]]) <= 2 * longest + 8 and (n + 1) * len(pages[order[n]]) <= 60_000:
                n += 1
            some, order = order[:n], order[n:]
            x, size = self.padded([pages[k] for k in some])
            p = self._forward(x, size, False)[0]
            for j, k in enumerate(some):
                out[k] = p[: size[j], j]
        return out


    def streamed(self, found: list[tuple[Node, str, int]]) -> np.ndarray:
        """Probability of each block of one page, read in parts of LONG blocks."""
        logit, parts = np.full(len(found), self.w["p"][0], np.float32), range(0, len(found), LONG)
        for d, order, out in (("f", parts, self.w["o"][:HIDDEN]), ("b", reversed(parts), self.w["o"][HIDDEN:])):
            state = None
            for a in order:
                x = vectors(found, a, a + LONG)[:: 1 if d == "f" else -1, None]
                hs, _, state = self._run(x, d, False, state)
                logit[a : a + LONG] += (hs[:, 0] @ out)[:: 1 if d == "f" else -1]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class Grammar:
    """Pages with known labels.  Article words lie between marks that the parser's text keeps."""

    #: Names by which sites call the parts of a page.
    PARTS = {
        "nav": ("nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "mainmenu", "tabs"),
        "header": ("header", "masthead", "top", "logo", "site header", "banner top", "branding"),
        "footer": ("footer", "bottom", "copyright", "site footer", "colophon", "legal"),
        "aside": ("sidebar", "widget", "related", "aside", "popular", "recent posts", "trending", "more stories", "tags", "share", "social"),
        "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner ad", "adbox"),
        "notice": ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "banner cookie", "paywall"),
        "comments": ("comments", "comment", "comment list", "reply", "responses", "discussion", "disqus", "reader comments"),
        "form": ("form", "search", "login", "signup", "contact form", "search box"),
    }
    ARTICLE = ("content", "post", "article", "entry", "story", "main", "body", "post content", "entry content", "article body", "text", "page")

    #: Share of the words that come from the other vocabulary, and share of texts in a language
    #: of their own, whose words tell nothing.
    MIXED, STRANGE = 0.3, 0.2

    def __init__(self, rng: np.random.Generator, article: dict[str, int], other: dict[str, int] | None = None):
        self.rng, self.kinds = rng, []
        for some in (article or other or {"word": 1}, other or article or {"word": 1}):
            names, n = list(some), np.array(list(some.values()), float)
            self.kinds.append((names, np.cumsum(n / n.sum())))

    def pick(self, some):
        return some[int(self.rng.integers(len(some)))]

    def said(self, low: int, high: int, kind: int = 1) -> str:
        """Words of articles (kind 0) or of other parts."""
        n = int(self.rng.integers(low, high + 1))
        if self.rng.random() < self.STRANGE:
            return " ".join("".join(map(chr, self.rng.integers(97, 123, size).tolist())) for size in self.rng.integers(1, 12, n))
        kinds = np.where(self.rng.random(n) < self.MIXED, 1 - kind, kind)
        place = self.rng.random(n)
        out = []
        for k, x in zip(kinds.tolist(), place.tolist(), strict=True):
            names, upto = self.kinds[k]
            out.append(names[min(int(np.searchsorted(upto, x)), len(names) - 1)])
        return " ".join(out).replace("<", "").replace(">", "")

    def named(self, words: str) -> str:
        value = words.replace(" ", self.pick("-_ "))
        return self.pick((f' class="{value}"', f' id="{value}"', f' class="{value} {self.pick(("clearfix", "col", "row", "box", "left", "x1"))}"'))

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.said(1, 4)}</a>' + self.pick(("</li>", "</li>", "")) for k in range(n))

    def part(self, kind: str) -> str:
        tag = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "ad": ("div", "div", "aside", "section"), "notice": ("div", "section", "aside"), "comments": ("section", "div", "ol"), "form": ("form", "div")}[kind]
        tag = self.pick(tag)
        bare = tag in ("nav", "header", "footer", "aside", "form") and self.rng.random() < 0.6
        name = "" if bare else self.named(self.pick(self.PARTS[kind]))
        said = self.said
        inner = {
            "nav": lambda: f"<ul>{self.links(int(self.rng.integers(3, 9)))}</ul>",
            "header": lambda: self.pick((f"<h1>{said(1, 4)}</h1>", f'<a href="/">{said(1, 3)}</a>', f"<div>{said(1, 3)}</div><p>{said(3, 9)}</p>")),
            "footer": lambda: self.pick((f"&copy; {said(1, 3)} &middot; {said(4, 14)}", f"<p>&copy; 2020 {said(2, 9)}</p><ul>{self.links(3)}</ul>", said(3, 14))),
            "aside": lambda: self.pick((f"<h3>{said(1, 3)}</h3><ul>{self.links(int(self.rng.integers(2, 6)))}</ul>", f"<h4>{said(1, 3)}</h4><p>{said(5, 30)}</p>", f"<p>{said(5, 40)}</p>")),
            "ad": lambda: self.pick((said(4, 14), f"<p>{said(4, 20)}</p>", f'<a href="#">{said(3, 9)}</a>', f"<span>{said(3, 9)}</span>")),
            "notice": lambda: self.pick((f"<p>{said(6, 30)}</p><button>{said(1, 2)}</button>", said(6, 25), f"<h2>{said(2, 4)}</h2><p>{said(5, 20)}</p>")),
            "comments": lambda: f"<h3>{said(1, 3)}</h3>" + "".join(f"<{t}{self.named(self.pick(('comment', 'reply', 'comment body')))}><b>{said(1, 2)}</b><p>{said(5, 60)}</p></{t}>" for t in [self.pick(("div", "li", "article"))] * int(self.rng.integers(1, 6))),
            "form": lambda: f"<label>{said(1, 3)}</label><input type=text><p>{said(2, 9)}</p><button>{said(1, 2)}</button>",
        }[kind]()
        return f"<{tag}{name}>{inner}</{tag}>"

    def body(self) -> str:
        """The article's blocks; every word is marked."""
        own = lambda a, b: re.sub(r"(\S+)", "\x01\\1", self.said(a, b, 0))
        loose = self.rng.random() < 0.4
        out = [f"<h1>{own(2, 12)}</h1>"] if self.rng.random() < 0.85 else []
        for _ in range(int(self.rng.integers(1, 16) if self.rng.random() < 0.85 else self.rng.integers(16, 160))):
            kind = self.rng.random()
            if kind < 0.62:
                out.append(f"<p>{own(1, 90)}</p>")
            elif kind < 0.72:
                out.append(f"<p><b>{own(2, 30)}<br><p>{own(1, 60)}</p>" if loose else f"<p><b>{own(1, 9)}</b> {own(3, 40)}</p>")
            elif kind < 0.8:
                out.append(f"<h2>{own(1, 7)}</h2>")
            elif kind < 0.86:
                out.append(f"<blockquote>{own(4, 40)}</blockquote>")
            elif kind < 0.92:
                out.append("<ul>" + "".join(f"<li>{own(1, 20)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.95:
                out.append(f'<p>{own(3, 30)} <a href="#">{own(1, 4)}</a> {own(2, 20)}</p>')
            elif kind < 0.97:
                out.append(f"<pre>{own(2, 20)}</pre>")
            else:
                out.append(self.part("ad"))
        return "".join(out)

    def page(self) -> str:
        holder = self.pick(("article", "article", "article", "main", "div", "div", "section"))
        name = self.named(self.pick(self.ARTICLE)) if holder in ("div", "section") or self.rng.random() < 0.3 else ""
        article = f"<{holder}{name}>{self.body()}" + (f"</{holder}>" if self.rng.random() < 0.95 else "")
        if self.rng.random() < 0.3:
            article = f"<main>{article}</main>" if holder != "main" else f"<div id=wrap>{article}</div>"
        before = [self.part(k) for k in ("header", "nav", "ad", "notice", "form", "aside") if self.rng.random() < 0.45]
        after = [self.part(k) for k in ("aside", "ad", "comments", "notice", "form", "nav", "footer") if self.rng.random() < 0.45]
        return f"<html><head><title>{self.said(1, 9)}</title></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"

    def example(self) -> tuple[np.ndarray, np.ndarray]:
        found = blocks(self.page())
        labels = np.array(["\x01" in text for _, text, _ in found], np.float32)
        return vectors([(p, t.replace("\x01", ""), n) for p, t, n in found]), labels


def plainly(node: Node) -> int | None:
    """0 for a block that stands in what is marked as an article, 1 for one in another part."""
    marks = node.marks()
    if marks & OTHER:
        return 1
    return 0 if marks & MAIN else None


OTHER = frozenset(x for some in Grammar.PARTS.values() for name in some for x in name.split()) | {"nav", "header", "footer", "aside", "form"}
MAIN = frozenset(x for name in Grammar.ARTICLE for x in name.split()) | {"article", "main"}


def page_words(pages: DataFrame, html_col: str, sample_pages: int) -> list[dict[str, int]]:
    """Words and their counts in plain article blocks and in those of other parts, VOCABULARY of
    each at most, of some sampled pages."""
    col = F.col(html_col)
    sample = pages.where(col.isNotNull()).select(col.alias("html")).orderBy(F.xxhash64("html"), "html").limit(sample_pages)

    def work(chunk):
        kind, word, n = [], [], []
        for h in chunk.column(0).to_pylist():
            times: dict = defaultdict(int)
            for node, text, _ in blocks(h):
                if (k := plainly(node)) is not None:
                    for w in text.split():
                        times[k, w] += 1
            for (k, w), c in times.items():
                kind.append(k)
                word.append(w)
                n.append(c)
        return [kind, word, n]

    counted = map_rows(sample, ["html"], "kind int, word string, n long", work).groupBy("kind", "word").agg(F.sum("n").alias("n"))
    out = []
    for k in (0, 1):
        rows = counted.where(F.col("kind") == k).orderBy(F.xxhash64("word"), "word").limit(VOCABULARY).collect()
        out.append({r["word"]: r["n"] for r in rows})
    return out


def fit_labeller(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> BiLSTM:
    """A labeller trained on made pages with words of some sampled pages."""
    rng = np.random.default_rng(SEED)
    grammar = Grammar(rng, *page_words(pages, html_col, sample_pages))
    model = BiLSTM.fresh(rng)
    model.train([x for x in (grammar.example() for _ in range(TRAIN_PAGES)) if len(x[1])], rng)
    return model


def save_labeller(spark: SparkSession, model: BiLSTM, path: str) -> None:
    """Writes the weights as a table of one row each."""
    rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in sorted(model.w.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, value array<float>").coalesce(1).write.mode("overwrite").parquet(path)


def load_labeller(spark: SparkSession, path: str) -> BiLSTM:
    return BiLSTM({r["name"]: np.array(r["value"], np.float32).reshape(r["shape"]) for r in spark.read.parquet(path).collect()})


def main_texts(model: BiLSTM, pages: list[str]) -> list[str]:
    found = [blocks(h) for h in pages]
    chances = model.predict([vectors(b) if len(b) <= LONG else vectors([]) for b in found])
    chances = [model.streamed(b) if len(b) > LONG else c for b, c in zip(found, chances, strict=True)]
    return ["\n\n".join(t for (_, t, _), p in zip(b, c, strict=True) if p >= 0.5) for b, c in zip(found, chances, strict=True)]


def extract_text(pages: DataFrame, model: BiLSTM, keep: list[str], html_col: str = "html") -> DataFrame:
    """The kept columns, text and n_chars of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model.w)
    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def work(chunk):
        texts = main_texts(BiLSTM(shared.value), [h or "" for h in chunk.column(len(keep)).to_pylist()])
        return [*(chunk.column(i) for i in range(len(keep))), texts, [len(t) for t in texts]]

    return map_rows(pages, [*keep, html_col], f"{kept}, text string, n_chars long", work)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit_labeller(pages), ["page_id", "url"])
