"""HTML extraction (operator 3): a linear-chain conditional random field over DOM leaf blocks.

A page is split into leaf blocks: stretches of text between block-level tags, each with its open
ancestors (tags, class and id words). A CRF with two labels, main text or not, scores each block by
ancestor and text features and each pair of neighbours by a transition; Viterbi gives the best
labelling, and main blocks make the text. The CRF is trained on the driver, by gradient ascent
on the exact conditional likelihood (forward-backward), on labelled pages that `labelled_pages`
writes from a seed: menus, headers, footers, sidebars, notices, adverts, forms and comments around
and inside articles of several layouts. The weights (a few hundred numbers) go along with the scan.

Pages are independent: one scan, no shuffle. Parsing is linear in the page: a quote in a tag that
is never closed is a plain character, and no search that found nothing is made twice.

Defined cases: null or empty html gives empty text; unclosed and stray tags are tolerated; scripts,
styles, text areas, comments, templates and noscript have no blocks, from the tag to its end tag (the
first four to the end of the page if there is none); buttons, selections, frames, drawings and media
are left out up to their end tag or the next block-level tag; a tag that the page's end cuts off is
markup; a page without any main block gives empty text; repeated rows give equal rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without text for a reader: all up to the end tag, and of the first three all of the page without one.
RAW = "script style textarea noscript template noframes".split()
HIDDEN = frozenset("svg iframe object canvas select option button audio video".split())
#: Elements that an opening tag of the same kind closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")  # most tags; none that holds a bracket
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
STOP = re.compile(r">|=\s*([\"'])")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORD = re.compile(r"[a-z]+")
BLANK = re.compile(r"\s+")


@lru_cache(50_000)
def marks(name: str, attributes: str) -> tuple[str, ...]:
    """An element's features: its tag and the words of its class, id and role."""
    found = {f"<{name}"}
    for m in NAMES.finditer(attributes):
        found |= {f".{w}" for w in WORD.findall((m[1] or m[2] or m[3] or "").lower())}
    return tuple(sorted(found))


@lru_cache(50_000)
def ancestors(path: tuple[tuple[str, ...], ...]) -> tuple[str, ...]:
    return tuple(sorted({m for element in path for m in element}))


class Tags:
    """The tags of a page from left to right."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        i = self.page.find(what, at)
        if i < 0:
            self.missing.add(what)
        return i

    def end(self, at: int) -> int:
        """The bracket that closes a tag, past quoted values that may hold brackets; -1 if there is none."""
        while m := STOP.search(self.page, at):
            if m[1] is None:
                return m.start()
            close = self.find(m[1], m.end())
            at = m.end() if close < 0 else close + 1
        return -1

    def at(self, i: int) -> tuple[int, str, str, str]:
        """(end, slash, name, attributes) of what starts at the bracket i; no name: a comment or the like; end i: text."""
        if m := TAG.match(self.page, i):
            return m.end(), m[1], m[2].lower(), m[3]
        for lead, close in (("<!--", "-->"), ("<!", ">"), ("<?", ">")):
            if self.page.startswith(lead, i):
                j = self.find(close, i + len(lead))
                return (len(self.page) if j < 0 else j + len(close)), "", "", ""
        if not (m := NAME.match(self.page, i)):
            return i, "", "", ""
        j = self.end(m.end())
        return (len(self.page), "", "", "") if j < 0 else (j + 1, m[1], m[2].lower(), self.page[m.end() : j])

    def behind(self, name: str, at: int) -> int:
        """The place behind an element without text for a reader."""
        m = None if name in self.missing else ENDS[name].search(self.page, at)
        if m:
            return m.end()
        self.missing.add(name)
        return len(self.page) if name in RAW[:3] else at


def blocks(page: str) -> list[tuple[str, tuple[tuple[str, ...], ...], int]]:
    """Leaf blocks (text, ancestors' marks, characters inside links) in page order."""
    out: list[tuple[str, tuple[tuple[str, ...], ...], int]] = []
    stack: list[str] = []
    path: list[tuple[str, ...]] = []
    text: list[str] = []
    linked, in_link, hidden, tags = 0, False, "", Tags(page)

    def flush() -> None:
        nonlocal linked
        if text:
            joined = BLANK.sub(" ", entities.unescape("".join(text))).strip()
            if joined:
                out.append((joined, tuple(path), linked))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            text.append(piece)
            linked += len(piece) if in_link else 0

    at = 0
    while (i := page.find("<", at)) >= 0:
        add(page[at:i])
        at, closing, name, attributes = tags.at(i)
        if at == i:
            add("<")
            at = i + 1
        elif name in BLOCKS:
            hidden = ""
            flush()
            if closing:
                if name in stack:
                    k = len(stack) - 1 - stack[::-1].index(name)
                    del stack[k:], path[k:]
            else:
                shut = CLOSES.get(name, ())
                while stack and (stack[-1] == "p" or stack[-1] in shut):
                    stack.pop(), path.pop()
                if name != "hr":
                    stack.append(name)
                    path.append(marks(name, attributes))
        elif name in ENDS:
            add(" ")
            if not closing and not attributes.endswith("/"):
                at = tags.behind(name, at)
        elif hidden:
            hidden = "" if closing and name == hidden else hidden
        elif name in HIDDEN:
            add(" ")
            hidden = "" if closing or attributes.endswith("/") else name
        elif name == "a":
            in_link = not closing
        elif name == "br":
            add(" ")
    add(page[at:])
    flush()
    return out


def text_features(text: str, linked: int) -> list[str]:
    n, words = len(text), text.count(" ") + 1
    out = [f"len{min(8, n.bit_length())}", f"words{min(6, words.bit_length())}", f"links{min(4, 5 * linked // max(1, n))}"]
    if text[-1] in ".!?:\"'":
        out.append("ends")
    if "©" in text or "copyright" in text.lower():
        out.append("copyright")
    if "|" in text or "·" in text or "»" in text:
        out.append("bars")
    return out


def features(block: tuple[str, tuple[tuple[str, ...], ...], int]) -> list[str]:
    text, path, linked = block
    return [*ancestors(path), *(f"in{path[-1][-1]}" if path else "none",), *text_features(text, linked)]


class Crf:
    """Two labels; weights of features, transitions and the start."""

    def __init__(self, names: list[str]):
        self.at = {n: i for i, n in enumerate(names)}
        self.weight = np.zeros(len(names) + 1)
        self.change = np.zeros((2, 2))

    def row(self, block) -> list[int]:
        return [self.at[f] for f in features(block) if f in self.at]

    def fit(self, pages: list[list[tuple[list[int], int]]], steps: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Crf:
        """Gradient ascent (Adagrad) on the likelihood of whole pages."""
        n, t = len(pages), max(map(len, pages))
        x = np.zeros((n, t, len(self.weight)), dtype=np.float32)
        y, real = np.zeros((n, t), int), np.zeros((n, t))
        for i, page in enumerate(pages):
            for j, (row, label) in enumerate(page):
                x[i, j, row] = 1
                x[i, j, -1] = 1
                y[i, j], real[i, j] = label, 1
        pair = real[:, 1:]
        seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & (pair > 0)).sum() for b in (0, 1)] for a in (0, 1)])
        flat = x.reshape(-1, x.shape[2])
        sum_w, sum_c = np.full(len(self.weight), 1e-6), np.full((2, 2), 1e-6)
        for _ in range(steps):
            score = np.stack((np.zeros((n, t)), x @ self.weight), axis=2) * real[:, :, None]
            ahead, back = np.zeros((n, t, 2)), np.zeros((n, t, 2))
            ahead[:, 0] = score[:, 0]
            for j in range(1, t):
                step = np.logaddexp(ahead[:, j - 1, 0:1] + self.change[0], ahead[:, j - 1, 1:2] + self.change[1]) + score[:, j]
                ahead[:, j] = np.where(real[:, j : j + 1] > 0, step, ahead[:, j - 1])
            for j in range(t - 2, -1, -1):
                nxt = back[:, j + 1] + score[:, j + 1]
                step = np.logaddexp(self.change[:, 0] + nxt[:, 0:1], self.change[:, 1] + nxt[:, 1:2])
                back[:, j] = np.where(real[:, j + 1 : j + 2] > 0, step, back[:, j + 1])
            whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            p = np.exp(ahead[:, :, 1] + back[:, :, 1] - whole[:, None]) * real
            expected = np.array([[(np.exp(np.minimum(0, ahead[:, :-1, a] + self.change[a, b] + score[:, 1:, b] + back[:, 1:, b] - whole[:, None])) * pair).sum() for b in (0, 1)] for a in (0, 1)])
            g = flat.T @ ((y * real - p).ravel()) / n - decay * self.weight
            c = (seen - expected) / n - decay * self.change
            sum_w += g * g
            sum_c += c * c
            self.weight += rate * g / np.sqrt(sum_w)
            self.change += rate * c / np.sqrt(sum_c)
        return self

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The labelling of largest score (Viterbi); ties to label 0."""
        (c00, c01), (c10, c11) = self.change.tolist()
        weight = self.values
        bias = weight[-1]
        a0 = a1 = 0.0
        links: list[tuple[int, int]] = []
        for i, row in enumerate(rows):
            s = bias + sum([weight[f] for f in row])
            if i == 0:
                a0, a1 = 0.0, s
                links.append((0, 0))
                continue
            from0, from1 = int(a1 + c10 > a0 + c00), int(a1 + c11 > a0 + c01)
            a0, a1 = max(a0 + c00, a1 + c10), max(a0 + c01, a1 + c11) + s
            links.append((from0, from1))
        label = int(a1 > a0)
        out = []
        for pair in reversed(links):
            out.append(label)
            label = pair[label]
        return out[::-1]

    @property
    def values(self) -> list[float]:
        if getattr(self, "_values", None) is None:
            self._values = self.weight.tolist()
        return self._values


OUTSIDE = ["menu", "navbar", "nav", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar", "footer", "copyright", "sidebar", "widget", "ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "cookie", "notice", "consent", "popup", "modal", "newsletter", "subscribe", "login", "search", "share", "social", "related", "recommended", "comment", "comments", "reply", "pagination", "tags", "meta"]
INSIDE = ["content", "article", "post", "entry", "story", "body", "text", "main", "page"]
SOUNDS = "an ber con da el for gra hin is jo ka lu men nor os pra qui ren sta tion u ver wi x ya zen".split()


def labelled_pages(count: int = 400, seed: int = 7) -> list[tuple[str, list[tuple[str, int]]]]:
    """Pages of many layouts with their blocks' labels: (html, [(text, label)]) in page order."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice(SOUNDS) for _ in range(r.randint(1, 4)))

    def words(lo: int, hi: int, end: str = ".") -> str:
        s = " ".join(word() for _ in range(r.randint(lo, hi)))
        return (s[0].upper() + s[1:] + r.choice([end, end, ""])) if s else s

    def page() -> tuple[str, list[tuple[str, int]]]:
        out, labels = [], []

        def leaf(tag: str, text: str, label: int, link: bool = False) -> None:
            out.append(f"<{tag}>" + (f'<a href="/{word()}">{text}</a>' if link else text) + (f"</{tag}>" if r.random() < 0.9 or tag not in ("p", "li") else ""))
            labels.append((text, label))

        def outside(depth: int = 0) -> None:
            kind = r.choice(OUTSIDE)
            tag = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "search": "form", "login": "form"}.get(kind, r.choice(["div", "section", "aside", "div"]))
            attribute = "" if tag in ("nav", "header", "footer", "aside") and r.random() < 0.6 else f' {r.choice(["class", "id"])}="{kind}{r.choice(["", "-" + word(), " " + word()])}"'
            out.append(f"<{tag}{attribute}>")
            shape = r.random()
            if shape < 0.4:
                out.append("<ul>")
                for _ in range(r.randint(2, 9)):
                    leaf("li", words(1, 3, ""), 0, True)
                out.append("</ul>")
            elif shape < 0.8 or depth:
                for _ in range(r.randint(1, 4)):
                    leaf(r.choice(["p", "div", "p", "span-block"]).replace("span-block", "div"), words(2, 60 if "comment" in kind or kind in ("ad", "notice", "promo", "sponsored") else 14), 0, r.random() < 0.2)
            else:
                text = r.choice(["© ", "", "Copyright "]) + words(3, 20)
                out.append(text)
                labels.append((text, 0))
            out.append(f"</{tag}>")

        title = words(3, 9, "")
        out.append(f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>")
        labels.append((title, 0))
        for _ in range(r.randint(0, 4)):
            outside()
        tag = r.choice(["article", "article", "main", "div", "section"])
        named = f' {r.choice(["class", "id"])}="{r.choice(INSIDE)}{r.choice(["", "-" + r.choice(INSIDE)])}"'
        out.append(f"<{tag}{named if tag in ('div', 'section') or r.random() < 0.3 else ''}>")
        if r.random() < 0.15:
            outside(1)
        if r.random() < 0.85:
            leaf(r.choice(["h1", "h1", "h2"]), title, 1)
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.75:
                leaf("p", words(1, 120) if r.random() < 0.8 else words(1, 4), 1)
            elif kind < 0.83:
                leaf(r.choice(["h2", "h3", "blockquote", "pre"]), words(2, 9, ""), 1)
            elif kind < 0.9:
                out.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    leaf("li", words(2, 15), 1)
                out.append("</ul>")
            elif kind < 0.94:
                out.append("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    leaf("td", words(1, 5, ""), 1)
                out.append("</tr></table>")
            else:
                outside(1)
        if r.random() < 0.3:
            outside(1)
        out.append(f"</{tag}>")
        for _ in range(r.randint(0, 4)):
            outside()
        if r.random() < 0.9:
            out.append("</body></html>")
        return "".join(out), labels

    return [page() for _ in range(count)]


@lru_cache(2)
def trained(count: int = 240, seed: int = 7) -> Crf:
    pages, counts = [], {}
    for page, labels in labelled_pages(count, seed):
        found = blocks(page)
        if [b[0] for b in found] != [BLANK.sub(" ", t).strip() for t, _ in labels]:
            continue  # a text that the parser joins with a neighbour has no label of its own
        rows = [(features(b), y) for b, (_, y) in zip(found, labels, strict=True)]
        pages.append(rows)
        for row, _ in rows:
            for f in set(row):
                counts[f] = counts.get(f, 0) + 1
    crf = Crf(sorted(f for f, n in counts.items() if n >= 3))
    return crf.fit([[([crf.at[f] for f in row if f in crf.at], y) for row, y in page] for page in pages])


def main_text(page: str | None, crf: Crf) -> str:
    if not page:
        return ""
    found = blocks(page)
    if not found:
        return ""
    return "\n\n".join(b[0] for b, y in zip(found, crf.decode([crf.row(b) for b in found]), strict=True) if y)


def extracted(crf: Crf):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [main_text(h, crf) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return common.releasing(run)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""
    rows = common.small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extracted(trained()), "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
