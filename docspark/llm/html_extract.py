"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of open
elements above it. A block is a vector of hashed tag-path tokens (tags, words of class, id and
role), hashed words and a few statistics. A bidirectional LSTM in numpy reads the page's blocks in
order and labels every block as main text or not from both directions, so a block is judged by the
whole page. The labelled blocks, references decoded and white space folded, are joined by line feeds.

The labeller is trained here, at each call, on ``TRAIN_PAGES`` generated pages: layouts are drawn by
rule (menus, headers with site titles, sidebars, notices, adverts, forms, comments and articles in many
kinds of containers, layouts by tables, pages of bare paragraphs or text, partly broken markup), and their sentences are all blocks of ``SAMPLE_PAGES`` pages of the
table, those with the smallest hashes of id and html, so that equal tables give equal models however
they are dealt. These two bounds are for training only; extraction reads every page whole.

Defined cases: null html is empty and has the empty text. Pages without blocks, or without main
blocks, have the empty text. Repeated rows have equal texts, pages of any length are one sequence, rows
with a null id are extracted like others. An empty table gives no rows; the labeller then learns from two
fixed sentences. Extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES, TRAIN_PAGES, EPOCHS, HIDDEN = 200, 1200, 12, 20
PATH_DIM, OWN_DIM, WORD_DIM, STAT_DIM = 512, 256, 32, 10
TAGS_DIM = PATH_DIM + OWN_DIM
DIM = TAGS_DIM + WORD_DIM + STAT_DIM

_ATTRS = r"""(?:[^<>"']|"[^"]*"|'[^']*')*"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|noscript|svg|iframe|title)\b" + _ATTRS + r">.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attrs>" + _ATTRS + r"|[^<>]*)>",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(class|id|role|style|type|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: What HTML calls these.
INLINE = frozenset("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ITEMS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": set()}
SCOPE = frozenset("article aside body div dl fieldset figure footer form header li main nav ol section table td th ul".split())


def _code(token: str, dim: int) -> int:
    return zlib.crc32(token.encode()) % dim


class Vocabulary:
    """Memos of hashed tokens; cleared when they grow."""

    def __init__(self) -> None:
        self.opened: dict[tuple, tuple] = {}
        self.words: dict[str, int] = {}

    def open_tag(self, tag: str, attrs: str) -> tuple:
        key = (tag, attrs)
        if (found := self.opened.get(key)) is None:
            if len(self.opened) > 100_000:
                self.opened.clear()
            tokens = [tag]
            for name, *values in NAMES.findall(attrs) if attrs else ():
                value, name = "".join(values), name.lower()
                if name == "style":
                    tokens += ["hidden"] if "none" in value and "display" in value else []
                elif name in ("hidden", "aria-hidden"):
                    tokens += [] if value == "false" else ["hidden"]
                elif name != "type":
                    tokens += WORD.findall(CAMEL.sub(" ", value).lower())
            self.opened[key] = found = tuple(dict.fromkeys(_code(t, PATH_DIM) for t in tokens))
        return found

    def word(self, w: str) -> int:
        if (k := self.words.get(w)) is None:
            if len(self.words) > 200_000:
                self.words.clear()
            self.words[w] = k = _code(w, WORD_DIM)
        return k


def blocks(page: str, vocabulary: Vocabulary) -> list[tuple[str, list[int], int, str]]:
    """(text, codes of the path and of its last two elements, characters in links, innermost block tag) of each leaf block, in order."""
    out: list = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            parts.clear()
            if text:
                codes = {c for _, cs in stack for c in cs}
                near = [x for x in stack if x[0] not in INLINE][-2:]
                codes.update(PATH_DIM + c % OWN_DIM for _, cs in near for c in cs)
                out.append((text, list(codes), linked, near[-1][0] if near else ""))
        linked = 0

    def close(tag: str, scope: frozenset | set) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if m["close"] else 1
            if m["close"]:
                close(tag, SCOPE)
            elif tag not in VOID:
                stack.append((tag, vocabulary.open_tag(tag, m["attrs"])))
            continue
        flush()
        if m["close"]:
            close(tag, frozenset())
            continue
        if tag in CLOSES_P:
            close("p", SCOPE)
        if tag in ITEMS and tag != "p":
            close(tag, ITEMS[tag])
        links = 0
        if tag not in VOID:
            stack.append((tag, vocabulary.open_tag(tag, m["attrs"])))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def vectors(page_blocks: list[tuple], vocabulary: Vocabulary) -> np.ndarray:
    """A row of DIM values for each block of one page."""
    n = len(page_blocks)
    x = np.zeros((n, DIM), np.float32)
    for k, (text, codes, linked, tag) in enumerate(page_blocks):
        row = x[k]
        row[codes] = 1
        words = text.split(" ")
        row[TAGS_DIM : TAGS_DIM + WORD_DIM] = np.bincount([vocabulary.word(w) for w in words], minlength=WORD_DIM) / len(words)
        size = len(text)
        row[TAGS_DIM + WORD_DIM :] = (
            np.log1p(size) / 5, min(1.0, linked / size), text[-1] in ".!?:\"'”", text[0].isupper(), len(words) < 4,
            k / n, tag == "p", tag in ("h1", "h2", "h3"), tag == "li", "©" in text,
        )
    return x


class Labeller:
    """A bidirectional LSTM with one output a block."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {f"{name}{d}": init(rows, 4 * h) for d in "fb" for name, rows in (("x", DIM), ("h", h))}
        for d in "fb":
            self.w[f"b{d}"] = np.zeros(4 * h, np.float32)
            self.w[f"b{d}"][h : 2 * h] = 1
        self.w["o"], self.w["c"] = init(2 * h, 1), np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """x: (steps, pages, DIM). The state of a page stays as it is where its mask is 0."""
        steps, n, _ = x.shape
        h = HIDDEN
        z = x.reshape(-1, DIM) @ self.w[f"x{d}"] + self.w[f"b{d}"]
        z = z.reshape(steps, n, 4 * h)
        out = np.zeros((steps, n, h), np.float32)
        state, cell, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[t] + state @ self.w[f"h{d}"]
            s = 1 / (1 + np.exp(-g[:, : 3 * h]))
            u = np.tanh(g[:, 3 * h :])
            new = s[:, h : 2 * h] * cell + s[:, :h] * u
            th = np.tanh(new)
            m = mask[t][:, None]
            kept.append((t, state, cell, s, u, new, th, m))
            state = m * (s[:, 2 * h :] * th) + (1 - m) * state
            cell = m * new + (1 - m) * cell
            out[t] = state
        return out, kept

    def _back(self, x: np.ndarray, d_out: np.ndarray, kept: list, d: str, grad: dict) -> None:
        h = HIDDEN
        n = x.shape[1]
        ds, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        dz = np.zeros((x.shape[0], n, 4 * h), np.float32)
        wh = self.w[f"h{d}"]
        gh = np.zeros_like(wh)
        for t, state, cell, s, u, _, th, m in reversed(kept):
            ds = ds + d_out[t]
            own, own_c = ds * m, dc * m
            i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            d_new = own_c + own * o * (1 - th * th)
            dg = np.concatenate([d_new * u * i * (1 - i), d_new * cell * f * (1 - f), own * th * o * (1 - o), d_new * i * (1 - u * u)], 1)
            dz[t] = dg
            gh += state.T @ dg
            ds = ds * (1 - m) + dg @ wh.T
            dc = dc * (1 - m) + d_new * f
        grad[f"h{d}"] = gh
        flat = dz.reshape(-1, 4 * h)
        grad[f"x{d}"], grad[f"b{d}"] = x.reshape(-1, DIM).T @ flat, flat.sum(0)

    @staticmethod
    def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, pages))
        x, mask = np.zeros((steps, len(pages), DIM), np.float32), np.zeros((steps, len(pages)), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, 1
        return x, mask

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each block of each page (pages have blocks)."""
        x, mask = self._pad(pages)
        both = np.concatenate([self._run(x, mask, "f")[0], self._run(x, mask, "b")[0]], 2)
        p = 1 / (1 + np.exp(-(both @ self.w["o"] + self.w["c"])[:, :, 0]))
        return [p[: len(page), k] for k, page in enumerate(pages)]

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 32, seed: int = 2) -> Labeller:
        rng = np.random.default_rng(seed)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        lots = [order[lo : lo + batch] for lo in range(0, len(order), batch)]
        m1, m2, step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for epoch in range(epochs):
            rate = 0.01 * 0.5 ** (epoch / 4)
            for k in rng.permutation(len(lots)):
                x, mask = self._pad([pages[i] for i in lots[k]])
                x[:, :, :TAGS_DIM] *= rng.random(x[:, :, :TAGS_DIM].shape, np.float32) > 0.05
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(lots[k]):
                    y[: len(labels[i]), j] = labels[i]
                (hf, kf), (hb, kb) = self._run(x, mask, "f"), self._run(x, mask, "b")
                both = np.concatenate([hf, hb], 2)
                p = 1 / (1 + np.exp(-(both @ self.w["o"] + self.w["c"])[:, :, 0]))
                d = ((p - y) * mask / mask.sum())[:, :, None]
                grad = {"o": both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1), "c": d.sum().reshape(1)}
                d_both = d * self.w["o"][:, 0]
                self._back(x, d_both[:, :, :HIDDEN], kf, "f", grad)
                self._back(x, d_both[:, :, HIDDEN:], kb, "b", grad)
                step += 1
                for name, g in grad.items():
                    m1[name] = 0.9 * m1[name] + 0.1 * g
                    m2[name] = 0.99 * m2[name] + 0.01 * g * g
                    self.w[name] = (self.w[name] - rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


#: Usual names of the parts of a page, for generated layouts.
CONTENT = "article content post entry story main text body page blog news single prose markdown copy rich readable".split()
BOILERPLATE = {
    "nav": "nav menu navbar navigation topnav links tabs".split(),
    "header": "header masthead top logo brand banner hero head site topbar".split(),
    "footer": "footer bottom copyright legal foot colophon site".split(),
    "aside": "sidebar aside widget rail secondary column side related trending popular recent".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted banner dfp adsense".split(),
    "notice": "cookie consent notice alert gdpr popup modal overlay banner message toast warning info".split(),
    "form": "form search login newsletter subscribe signup contact field input".split(),
    "comments": "comments comment reply replies discussion respond disqus thread reader responses feedback".split(),
    "share": "share social sharing follow tags meta byline author breadcrumb breadcrumbs pagination pager related recommended more".split(),
}
NEUTRAL = "wrapper container row col inner outer grid box block section area left right primary layout clearfix module unit wrap css jsx sc".split()
LINKED = ("nav", "share", "footer", "aside")


class Layouts:
    """Generated pages with a label for each piece of text."""

    def __init__(self, sentences: list[str], seed: int = 3):
        self.rng, self.sentences = np.random.default_rng(seed), sentences
        self.out: list[str] = []
        self.labels: list[tuple[str, int]] = []

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        out: list[str] = []
        while len(out) < n:
            out += self.pick(self.sentences).split()
        return " ".join(out[:n]) + (self.pick([".", ".", "", "!"]) if n > 4 else "")

    def attrs(self, names: list[str]) -> str:
        if self.chance(0.15):
            return ""
        chosen = [self.pick(names)] + [self.pick(NEUTRAL)] * self.chance(0.3)
        value = self.pick(["-", "_", " "]).join(chosen) + (str(int(self.rng.integers(99))) if self.chance(0.2) else "")
        return f' {self.pick(["class", "class", "id"])}="{value}"'

    def put(self, tag: str, text: str, label: int, attrs: str = "") -> None:
        """One leaf; some lack their end tag, some have inline markup."""
        escaped = text.replace("&", "&amp;").replace("<", "&lt;")
        if self.chance(0.15) and " " in escaped:
            head, rest = escaped.split(" ", 1)
            inline = self.pick(["b", "em", "strong", 'a href="/x"', "span"])
            escaped = f"<{inline}>{head}</{inline.split()[0]}> {rest}"
        if tag == "p" and self.chance(0.1):
            self.out.append(f"<p><b>{escaped}<br>")
        else:
            self.out.append(f"<{tag}{attrs}>{escaped}" + ("" if tag in ("p", "li") and self.chance(0.1) else f"</{tag.split()[0]}>"))
        self.labels.append((" ".join(text.split()), label))

    def wrapped(self, tag: str, attrs: str, fill) -> None:
        self.out.append(f"<{tag}{attrs}>")
        fill()
        self.out.append(f"</{tag}>")

    def link_list(self, label: int = 0) -> None:
        def fill() -> None:
            for _ in range(int(self.rng.integers(2, 8))):
                text = self.words(1, 3)
                self.out.append(f'<li><a href="/{text[:3]}">{text.replace("&", "&amp;").replace("<", "&lt;")}</a></li>')
                self.labels.append((" ".join(text.split()), label))

        self.wrapped("ul", "", fill)

    def boilerplate(self, kind: str) -> None:
        own = {"nav": ["nav", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div"], "form": ["form", "form", "div"], "comments": ["section", "div", "ol"]}.get(kind, ["div", "div", "section"])
        tag = self.pick(own)
        attrs = self.attrs(BOILERPLATE[kind])
        if tag in ("div", "section", "ol") and not attrs:
            attrs = f' class="{self.pick(BOILERPLATE[kind])}"'

        def fill() -> None:
            if kind == "comments":
                if self.chance(0.7):
                    self.put(self.pick(["h2", "h3"]), self.words(1, 4), 0)
                for _ in range(int(self.rng.integers(1, 6))):
                    inner = lambda: [self.put(self.pick(["span", "div", "cite"]), self.words(1, 2), 0) if self.chance(0.5) else None, *(self.put("p", self.words(3, 70), 0) for _ in range(int(self.rng.integers(1, 3))))]
                    self.wrapped(self.pick(["div", "li", "article"]), f' class="{self.pick(BOILERPLATE["comments"])}"', inner)
                if self.chance(0.4):
                    self.boilerplate("form")
                return
            if kind == "form":
                self.put("label", self.words(1, 4), 0)
                if self.chance(0.5):
                    self.put("p", self.words(3, 25), 0)
                self.out.append('<input type="text">')
                self.put("button", self.words(1, 2), 0)
                return
            if kind == "header" and self.chance(0.7):  # the name of the site, as heading, link or plain
                self.put(self.pick(["h1", "h1", "h2", "div", "p", "span", 'a href="/"']), self.words(1, 4), 0)
            if kind == "footer" and self.chance(0.4):  # a line of rights alone
                text = self.pick(["© ", "© ", "Copyright ", ""]) + self.pick(["", f"{int(self.rng.integers(1995, 2030))} "]) + self.words(1, 4)
                if self.chance(0.5):
                    self.put(self.pick(["p", "p", "div", "span", "small"]), text, 0)
                else:
                    self.out.append(text.replace("&", "&amp;").replace("<", "&lt;"))
                    self.labels.append((" ".join(text.split()), 0))
                if self.chance(0.6):
                    return
            if kind in LINKED and self.chance(0.8):
                if self.chance(0.3):
                    self.put(self.pick(["h3", "h4", "div"]), self.words(1, 4), 0)
                self.link_list()
            if kind not in LINKED or self.chance(0.5):
                for _ in range(int(self.rng.integers(1, 4))):
                    self.put(self.pick(["p", "p", "div", "span", "h4"]), ("© " if kind == "footer" and self.chance(0.5) else "") + self.words(2, 45), 0)
            elif self.chance(0.4):
                text = self.words(3, 30)  # bare text in the part itself
                self.out.append(text.replace("&", "&amp;").replace("<", "&lt;"))
                self.labels.append((" ".join(text.split()), 0))

        if self.chance(0.25) and kind in ("ad", "notice", "share", "header", "footer"):
            self.put("div" if tag != "footer" else "footer", self.words(2, 30), 0, attrs)
        else:
            self.wrapped(tag, attrs, fill)

    def article(self) -> None:
        if self.chance(0.8):
            self.put("h1", self.words(1, 14), 1)
        for _ in range(int(self.rng.integers(1, 14))):
            r = self.rng.random()
            if r < 0.66:
                self.put("p" if self.chance(0.9) else "div", self.words(1, 6) if self.chance(0.25) else self.words(5, 120), 1)
            elif r < 0.73:
                self.put(self.pick(["h2", "h3"]), self.words(1, 8), 1)
            elif r < 0.79:
                self.wrapped(self.pick(["ul", "ol"]), "", lambda: [self.put("li", self.words(2, 20), 1) for _ in range(int(self.rng.integers(1, 5)))])
            elif r < 0.83:
                self.put(self.pick(["blockquote", "pre", "figcaption"]), self.words(3, 40), 1)
            elif r < 0.85:
                self.wrapped("table", "", lambda: self.wrapped("tr", "", lambda: [self.put("td", self.words(1, 6), 1) for _ in range(3)]))
            else:
                self.boilerplate(self.pick(["ad", "share", "form", "aside", "notice"]))

    def nested(self, depth: int, fill) -> None:
        if depth:
            self.wrapped("div", self.attrs(NEUTRAL), lambda: self.nested(depth - 1, fill))
        else:
            fill()

    def bare(self) -> tuple[str, list[tuple[str, int]]]:
        """A page without parts: text alone, or headings and paragraphs of the body or of one container; all of it is main text."""
        self.out, self.labels = ["<html><body>"] if self.chance(0.5) else [], []
        if self.chance(0.35):
            text = self.words(1, 8) if self.chance(0.3) else self.words(5, 200)
            self.out.append(text.replace("&", "&amp;").replace("<", "&lt;"))
            self.labels.append((" ".join(text.split()), 1))
            return "".join(self.out), self.labels

        def fill() -> None:
            if self.chance(0.4):
                self.put(self.pick(["h1", "h1", "h2"]), self.words(1, 12), 1)
            for _ in range(int(self.rng.integers(1, 5))):
                self.put(self.pick(["p", "p", "p", "div", "pre", "li"]), self.words(2, 8) if self.chance(0.3) else self.words(5, 120), 1)

        self.nested(int(self.rng.integers(0, 2)), fill)
        return "".join(self.out), self.labels

    def tabled(self) -> tuple[str, list[tuple[str, int]]]:
        """A page laid out by a table: the name of the site above, a cell of links, a cell with the article, a line below."""
        self.out, self.labels = ["<html><head><title>x</title></head><body>"], []
        row = lambda fill: self.wrapped("tr", "", fill)
        names = lambda kind: self.attrs(BOILERPLATE[kind]) if self.chance(0.4) else self.pick(["", ' width="20%"', ' valign="top"'])

        def links() -> None:
            if self.chance(0.4):
                self.put(self.pick(["b", "h3", "p"]), self.words(1, 3), 0)
            if self.chance(0.4):
                self.link_list()
                return
            wrap = self.pick(["", "p", "div", "br"])
            if wrap in ("p", "div"):
                for _ in range(int(self.rng.integers(2, 8))):
                    self.wrapped(wrap, "", lambda: self.put('a href="/x"', self.words(1, 3), 0))
                return
            texts = [self.words(1, 3) for _ in range(int(self.rng.integers(1, 8)))]  # one block of links
            mark = self.pick(["<br>", " | ", " "])
            self.out.append(mark.join(f'<a href="/x">{t.replace("&", "&amp;").replace("<", "&lt;")}</a>' for t in texts))
            self.labels.append((" ".join(mark.replace("<br>", " ").join(texts).split()), 0))

        def body() -> None:
            if self.chance(0.7):
                row(lambda: self.put("td", self.words(1, 5), 0, self.pick(["", ' colspan="2"'])) if self.chance(0.6) else self.wrapped("td", names("header"), lambda: self.put(self.pick(["h1", "h2", "b", "font"]), self.words(1, 5), 0)))
            cells = [lambda: self.wrapped("td", names("nav"), links), lambda: self.wrapped("td", self.attrs(CONTENT) if self.chance(0.3) else self.pick(["", ' width="80%"']), self.article)]
            if self.chance(0.25):
                cells.reverse()
            if self.chance(0.2):
                cells.append(lambda: self.wrapped("td", names("aside"), links))
            row(lambda: [c() for c in cells])
            if self.chance(0.7):
                row(lambda: self.put("td", ("© " if self.chance(0.5) else "") + self.words(2, 12), 0, self.pick(["", ' colspan="2"'])))

        self.wrapped("table", self.pick(["", ' width="100%"', ' cellpadding="0"', ' class="layout"']), lambda: self.wrapped("tbody", "", body) if self.chance(0.3) else body())
        return "".join(self.out) + "</body></html>", self.labels

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        kind = self.rng.random()
        return self.bare() if kind < 0.08 else self.tabled() if kind < 0.2 else self.parted()

    def parted(self) -> tuple[str, list[tuple[str, int]]]:
        self.out, self.labels = ["<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>"], []

        def body() -> None:
            for kind in ("notice", "header", "nav", "form", "share", "ad"):
                if self.chance({"nav": 0.8, "header": 0.5, "ad": 0.4}.get(kind, 0.2)):
                    self.boilerplate(kind)
            if self.chance(0.2):
                self.boilerplate("aside")
            if self.chance(0.97):
                tag, attrs = self.pick([("article", ""), ("article", self.attrs(CONTENT)), ("main", self.attrs(CONTENT)), ("div", self.attrs(CONTENT)), ("div", self.attrs(CONTENT)), ("section", self.attrs(CONTENT)), ("td", self.attrs(CONTENT)), ("div", "")])
                self.nested(int(self.rng.integers(0, 3)), lambda: self.wrapped(tag, attrs, self.article))
            for kind in ("share", "ad", "aside", "comments", "form", "notice", "nav", "footer"):
                if self.chance({"footer": 0.8, "comments": 0.35, "aside": 0.35}.get(kind, 0.15)):
                    self.boilerplate(kind)

        self.nested(int(self.rng.integers(0, 2)), body)
        return "".join(self.out) + ("</body></html>" if self.chance(0.9) else ""), self.labels


def train(sample: list[str], pages: int = TRAIN_PAGES) -> Labeller:
    """The labeller, trained on generated pages with sentences of the sample."""
    vocabulary = Vocabulary()
    sentences = [t for page in sample for t, _, _, _ in blocks(page, vocabulary)] or ["One two three four five.", "Six seven eight."]
    layouts, x, y = Layouts(sentences), [], []
    for _ in range(pages):
        page, labels = layouts.page()
        found = blocks(page, vocabulary)
        # Blocks and labelled pieces are in the same order; a block takes the label of its piece.
        at, own = 0, []
        for text, *_ in found:
            label = next((k for k in range(at, len(labels)) if labels[k][0] == text), None)
            if label is None:  # inline pieces side by side are one block
                label = next((k for k in range(at, min(at + 2, len(labels))) if text.startswith(labels[k][0])), None)
            if label is None:
                label = at - 1 if at else 0
            else:
                at = label + 1
            own.append(labels[min(label, len(labels) - 1)][1])
        if found:
            x.append(vectors(found, vocabulary))
            y.append(np.array(own, np.float32))
    return Labeller().fit(x, y)


def _extractor(model: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                found = [blocks(h or "", vocabulary) for h in part.column(2).to_pylist()]
                texts = [""] * len(found)
                order = sorted((k for k in range(len(found)) if found[k]), key=lambda k: len(found[k]))
                while order:
                    # About 4,000 blocks a lot; a page longer than that is a lot of its own.
                    n = max(1, 4000 // len(found[order[0]]))
                    while n > 1 and n * len(found[order[min(n, len(order)) - 1]]) > 8000:
                        n //= 2
                    lot, order = order[:n], order[n:]
                    for k, p in zip(lot, model.scores([vectors(found[k], vocabulary) for k in lot]), strict=True):
                        texts[k] = "\n".join(block[0] for block, x in zip(found[k], p, strict=True) if x >= 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, found), pa.int32())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    return run


def fit_on(rows: DataFrame, sample_pages: int = SAMPLE_PAGES, train_pages: int = TRAIN_PAGES) -> Labeller:
    """The labeller for a table with page_id and html. One task trains it, on the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [h or "" for b in batches for h in b.column(0).to_pylist()]
        weights = train(sorted(sample), train_pages).w
        yield pa.RecordBatch.from_arrays([pa.array(list(weights)), pa.array([w.tobytes() for w in weights.values()], pa.binary())], names=["name", "data"])

    # The ids are found by their hashes first, so that no other page's html is moved.
    digest = F.xxhash64("page_id", "html").alias("digest")
    least = rows.select(digest).distinct().orderBy("digest").limit(sample_pages)
    picked = rows.select(digest, "html").join(F.broadcast(least), "digest")  # at most sample_pages rows
    sample = picked.groupBy("digest").agg(F.min("html").alias("html")).select("html").repartition(1)
    model = Labeller()
    for name, data in sample.mapInArrow(run, "name string, data binary").collect():
        model.w[name] = np.frombuffer(data, np.float32).reshape(model.w[name].shape)
    return model


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) for each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    model = fit_on(rows, sample_pages, train_pages)
    return rows.mapInArrow(_extractor(model), "page_id long, url string, text string, n_chars long, n_blocks int")
