"""Op 2: main text of web pages.

A page becomes flat text blocks.  Each block has its word count, link density and kind of element (bare text, paragraph
or heading), those of its neighbours, and the HTML section it stands in (article or main; nav, aside and the like;
none).  A decision tree, trained here on the blocks of a small table of labelled pages, tells the article's blocks from
the rest.  Names of classes and ids play no part.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import PAGES

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_PLAIN_END = re.compile(r"[^<>\"']*>")
_ATTRIBUTE = re.compile(r"[\s/]*(?:[^\s/>=][^\s/>=]*|=)?(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]*))?")
_COMMENT_END = re.compile(r"--!?>")
_SPACE = re.compile(r"\s+")
#: Elements whose content is text to the parser but not text of the page; they end at their own end tag only.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in "script style title textarea iframe xmp noembed noframes".split()}
#: Elements whose content is never text of the page.  Of those, the ones that a paragraph or section inside them ends.
_SILENT = frozenset("noscript template svg object select button canvas audio video".split())
_BREAKABLE = frozenset("svg select button".split())
#: Elements that do not end a block; unknown ones don't either.
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_KIND = dict.fromkeys("p pre blockquote li dd dt td th figcaption caption".split(), 1) | dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), 2)
_SECTION = dict.fromkeys("article main".split(), 1) | dict.fromkeys("nav aside footer form menu dialog fieldset search".split(), -1) | {"header": 0}


class Blocks:
    """Collects the flat text blocks of one page, in one pass: (text, words, words in links, kind, section, start)."""

    def __init__(self, page: str):
        self.found: list[tuple[str, int, int, int, int, int]] = []
        self.text: list[str] = []
        self.linked: list[str] = []
        self.stack: list[tuple[str, int]] = []
        self.in_link, self.silent, self.kind, self.start = False, "", 0, 0
        at = 0
        while at < len(page):
            opens = page.find("<", at)
            if opens < 0:
                opens = len(page)
            self._add(page[at:opens], at)
            at = self._markup(page, opens) if opens < len(page) else opens
        self._close()
        if any(b[4] > 0 for b in self.found):  # beside an article, what stands in no section is outside of it
            self.found = [(*b[:4], b[4] or -1, b[5]) for b in self.found]

    def _markup(self, page: str, at: int) -> int:
        """Handles what begins with the < at ``at`` and returns where it ends.  What is never closed goes to the end."""
        name = _NAME.match(page, at + 1)
        if page.startswith("<!--", at):
            end = _COMMENT_END.search(page, at + 2)
            return end.end() if end else len(page)
        if not name:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                return page.find(">", at) + 1 or len(page)
            self._add("<", at)
            return at + 1
        end = _PLAIN_END.match(page, name.end())
        upto = end.end() if end else self._attributes(page, name.end())
        closing, tag = name[0][0] == "/", name[0].strip("/").lower()
        self._tag(tag, closing)
        if tag in _RAW and not closing:
            over = _RAW[tag].search(page, upto)
            return over.start() if over else len(page)
        return upto

    @staticmethod
    def _attributes(page: str, at: int) -> int:
        """The end of a tag with quotes; a quote counts only where an attribute's value begins."""
        while at < len(page) and page[at] != ">":
            at = max(_ATTRIBUTE.match(page, at).end(), at + 1)
        return min(at + 1, len(page))

    def _add(self, raw: str, at: int) -> None:
        if raw and not self.silent:
            if not self.text:
                self.start = at
            self.text.append(raw)
            if self.in_link:
                self.linked.append(raw)

    def _close(self) -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(self.text))).strip()
        if text:
            words = text.count(" ") + 1
            linked = len(entities.unescape(" ".join(self.linked)).split())
            self.found.append((text, words, min(linked, words), self.kind, self.stack[-1][1] if self.stack else 0, self.start))
        self.text, self.linked = [], []

    def _tag(self, name: str, end: bool) -> None:
        if self.silent:
            if (end and name == self.silent) or (self.silent in _BREAKABLE and name in _BLOCK and name not in ("option", "optgroup", "br", "hr")):
                self.silent = ""
            if self.silent or end and name in _SILENT:
                return
        elif name in _SILENT and not end:
            self._close()
            self.silent = name
            return
        if name == "a":
            self.in_link = not end
        if name in _BLOCK:
            self._close()
            if name not in ("br", "hr"):
                self.kind = 0 if end else _KIND.get(name, 0)
        if name in _SECTION:
            if end:
                for i in range(len(self.stack) - 1, max(len(self.stack) - 64, -1), -1):  # deeper nesting is no page
                    if self.stack[i][0] == name:
                        del self.stack[i:]
                        break
            else:
                outer = self.stack[-1][1] if self.stack else 0
                own = _SECTION[name] if name != "header" or outer > 0 else -1
                self.stack.append((name, -1 if outer < 0 else own or outer))


def block_features(blocks: list[tuple]) -> np.ndarray:
    """Words, link density and kind of each block, of the one before and of the one after (0 where there is none), and its section."""
    words = np.array([0, *(b[1] for b in blocks), 0], float)
    density = np.array([0, *(b[2] for b in blocks), 0], float) / np.maximum(words, 1)
    kind = np.array([0, *(b[3] for b in blocks), 0], float)
    near = [x[s] for s in (slice(1, -1), slice(None, -2), slice(2, None)) for x in (words, density, kind)]
    return np.stack([*near, np.array([b[4] for b in blocks], float)], 1)


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
    """A classification tree by Gini impurity: a leaf is its share of main text, a node (feature, cut, below, above)."""
    best = None
    if depth and len(y) >= 2 * least and 0 < y.mean() < 1:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] < cut
                n = low.sum()
                if least <= n <= len(y) - least:
                    impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                    if best is None or impurity < best[0] - 1e-9:
                        best = (impurity, f, float(cut), low)
    if best is None:
        return float(y.mean())
    _, f, cut, low = best
    return f, cut, train_tree(x[low], y[low], depth - 1, least), train_tree(x[~low], y[~low], depth - 1, least)


def classify(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, below, above = tree
    low, out = x[:, f] < cut, np.empty(len(x))
    out[low], out[~low] = classify(below, x[low]), classify(above, x[~low])
    return out


def labelled_blocks(pages: list[list[tuple[int, str]]] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the labelled pages; a block has the label of the piece of html it begins in."""
    x, y = [], []
    for page in pages:
        blocks = Blocks("".join(piece for _, piece in page)).found
        upto = np.cumsum([len(piece) for _, piece in page])
        x.append(block_features(blocks))
        y += [page[int(np.searchsorted(upto, b[5], side="right"))][0] for b in blocks]
    return np.concatenate(x), np.array(y, float)


def trained(pages: list[list[tuple[int, str]]] = PAGES):
    return train_tree(*labelled_blocks(pages))


def extract(page: str, tree) -> str:
    """The main text: blocks that the tree accepts, in page order, joined by one space."""
    blocks = Blocks(page).found
    if not blocks:
        return ""
    good = classify(tree, block_features(blocks)) >= 0.5
    return " ".join(b[0] for b, g in zip(blocks, good) if g)


def main_texts(pages: DataFrame, labelled: list[list[tuple[int, str]]] = PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    Null html is empty; a page without main text has an empty text.  A page is read in one pass, so a very long or broken one
    takes time in proportion to its length.  Repeated rows give repeated results, an empty table gives none,
    null ids and urls stay null, extra columns are ignored.  No two blocks tie: each is judged by itself.
    """
    tree = trained(labelled)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [extract(h, tree) for h in pdf["html"]]
            out = pdf.drop(columns="html").assign(text=texts, n_chars=[len(t) for t in texts])
            yield out

    page_id = F.col("page_id").cast("long")
    own = pages.select(F.coalesce(page_id, F.lit(0).cast("long")).alias("page_id"), page_id.isNull().alias("_null"), "url", F.coalesce("html", F.lit("")).alias("html"))
    found = own.mapInPandas(run, "page_id long, _null boolean, url string, text string, n_chars long")
    return found.select(F.expr("if(_null, null, page_id)").alias("page_id"), "url", "text", "n_chars")
