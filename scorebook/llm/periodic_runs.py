"""Op 11: runs of repeated words, found online by catchers over completed power-of-two blocks.

At level k the words are cut into blocks of m = 2^k.  Once a block is complete, a catcher looks among the words that follow for the
block again, p words on with m <= p < 2m: then two stretches p words apart agree, part of a square of period p.  Every run of three periods
p holds a whole block of its level within its first 2m words, so each is caught.  A catch is one suffix comparison of the text with itself p words
earlier: it is driven back to where it began, and every appended word advances it while it goes on.  Catches of one period that touch merge
into the run.  Blocks are first met by a hash of their words; words decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_and_text, null_back, slices

ROWS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier


def _hash(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def agree(words: np.ndarray, a: np.ndarray, b: np.ndarray, way: int, most: int | np.ndarray) -> np.ndarray:
    """How many words from ``a`` and from ``b`` on, forwards (1) or backwards (-1), are equal; at most ``most``."""
    n, done = len(words), np.zeros(len(a), np.int64)
    room = np.clip(n - np.maximum(a, b) if way > 0 else np.minimum(a, b) + 1, 0, most)
    live, width = np.flatnonzero(room > 0), 4
    while len(live):
        step = np.arange(width)
        for part in np.array_split(live, max(1, len(live) * width // 4_000_000)):
            at, left = done[part, None] + step, room[part]
            inside = at < left[:, None]
            x, y = a[part, None] + way * at, b[part, None] + way * at
            same = (words[np.where(inside, x, 0)] == words[np.where(inside, y, 0)]) & inside
            done[part] += np.where(same.all(1), width, same.argmin(1))
            room[part] = np.where(same.all(1), left, done[part])
        live = live[done[live] < room[live]]
        width = min(width * 2, 1 << 16)
    return done


def merged(catches: np.ndarray) -> np.ndarray:
    """Rows (period, lo, hi) with those of one period that touch or overlap made one."""
    if len(catches) < 2:
        return catches
    p, lo, hi = catches[np.lexsort((catches[:, 1], catches[:, 0]))].T
    first = np.r_[True, p[1:] != p[:-1]]
    span = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + np.cumsum(first) * span) - np.cumsum(first) * span  # the furthest end so far under this period
    begins = first | np.r_[True, lo[1:] > reach[:-1]]
    at = np.flatnonzero(begins)
    return np.stack([p[at], lo[at], np.maximum.reduceat(hi, at)], 1)


class Level:
    """The catchers of blocks of ``m`` words."""

    def __init__(self, m: int):
        self.m, self.block, self.base, self.hashes, self.open = m, 0, 0, np.empty(0, np.uint64), np.empty((0, 3), np.int64)

    def advance(self, words: np.ndarray, below: Level | None, last: bool) -> list[np.ndarray]:
        """Takes in the words appended since the last call; returns the runs that ended, as (period, lo, hi): words lo to hi equal those
        ``period`` words on."""
        m, n = self.m, len(words)
        known = self.base + len(self.hashes)
        if n - m + 1 > known:
            if below is None:
                new = _hash(words[known:].astype(np.uint64) + np.uint64(1))
            else:
                h, k = below.hashes, known - below.base
                new = _hash(h[k : n - m + 1 - below.base] * np.uint64(3) + np.roll(h, -(m // 2))[k : n - m + 1 - below.base])
            self.hashes = np.concatenate([self.hashes, new])
        ready = n // m if last else max(self.block, n // m - 5)  # a catcher looks at five blocks behind its own
        found, some = [self.open], max(1, (1 << 20) // m)
        for at in range(self.block, ready, some):
            found.append(self.caught(words, at, min(ready, at + some)))
        self.block = max(self.block, ready)
        catches = self.extended(words, merged(np.concatenate(found)))
        going = (catches[:, 0] + catches[:, 2] == n) & (not last)
        self.open = catches[going]
        return [catches[~going & (catches[:, 2] - catches[:, 1] >= 2 * catches[:, 0])]]

    def trim(self, above: Level | None) -> None:
        """Forgets hashes of finished blocks that the level above has taken in."""
        upto = min(self.block * self.m, above.base + len(above.hashes) if above else 1 << 62) - self.base
        if upto > 0:
            self.hashes, self.base = self.hashes[upto:], self.base + upto

    def caught(self, words: np.ndarray, first: int, end: int) -> np.ndarray:
        """Catches (period, lo, hi) of the blocks ``first`` to ``end``."""
        m, n, h = self.m, len(words), self.hashes
        window = np.zeros((end - first) * m, np.uint64)
        there = h[(first + 1) * m - self.base :][: len(window)]
        window[: len(there)] = there
        own = h[first * m - self.base :: m][: end - first]
        row, col = np.nonzero(window.reshape(-1, m)[: len(own)] == own[:, None])
        b, p = (first + row) * m, m + col
        whole = b + p + m <= n
        row, b, p = row[whole], b[whole], p[whole]
        if not len(b):
            return np.empty((0, 3), np.int64)
        # a block of a period d up to m / 3 is met every d words: of such a series only the distances between the ends of the d-periodic stretches count
        near = np.r_[False, (row[1:] == row[:-1]) & (3 * (p[1:] - p[:-1]) <= m)]
        begins = np.flatnonzero(~near)
        size = np.diff(begins, append=len(near))
        series = np.flatnonzero(size > 1)
        if len(series):
            at, to = begins[series], begins[series] + size[series] - 1
            d, x = p[at + 1] - p[at], b[at] + p[at]
            sure = (agree(words, b[at], x, 1, m) == m) & (agree(words, x, x + d, 1, p[to] - p[at] + m - d) == p[to] - p[at] + m - d)
            series = series[sure]  # the words say so too; what only hashes say is looked at one by one
        alone = np.ones(len(begins), bool)
        alone[series] = False
        single = np.repeat(alone, size)
        many = begins[series]
        bs, ps = [b[single]], [p[single]]
        if len(many):
            lead, p1, p2 = b[many], p[many], p[many + size[series] - 1]
            d, x1, x2 = p[many + 1] - p1, lead + p1, lead + p2 + m
            left = x1 - agree(words, x1 - 1, x1 - 1 + d, -1, 4 * m) - (lead - agree(words, lead - 1, lead - 1 + d, -1, 4 * m))
            right = x2 + agree(words, x2, x2 - d, 1, 4 * m) - (lead + m + agree(words, lead + m, lead + m - d, 1, 4 * m))
            for q in (left, right):
                fits = (q >= m) & (q < 2 * m) & (lead + q + m <= n)
                bs.append(lead[fits])
                ps.append(q[fits])
        b, p = np.concatenate(bs), np.concatenate(ps)
        sure = agree(words, b, b + p, 1, m) == m
        return np.stack([p[sure], b[sure], b[sure] + m], 1)

    def extended(self, words: np.ndarray, catches: np.ndarray) -> np.ndarray:
        """Catches driven to where they begin and, by the words so far, end; those that meet on the way become one."""
        most, full = 2 * self.m, np.ones(len(catches), bool)
        while full.any():
            p, lo, hi = catches[full].T
            back, on = agree(words, lo - 1, lo - 1 + p, -1, most), agree(words, hi, hi + p, 1, most)
            moved = np.stack([p, lo - back, hi + on], 1)
            grew = (back == most) | (on == most)
            catches = merged(np.concatenate([catches[~full], moved]))
            most *= 2
            full = np.zeros(len(catches), bool)
            full[np.searchsorted(_key(catches), _key(moved[grew]), "right") - 1] = True  # what went as far as it was allowed goes on
        return catches


def _key(catches: np.ndarray) -> np.ndarray:
    return catches[:, 0] * (1 << 40) + catches[:, 1]


class RunFinder:
    """Runs of a stream of words, given as numbers >= 0.  ``longest`` bounds the words that one run can have."""

    def __init__(self, longest: int):
        self.words, self.levels, self.found = np.empty(0, np.int64), [Level(1 << k) for k in range(max(1, (longest // 3).bit_length()))], []

    def append(self, words: np.ndarray, last: bool = False) -> None:
        self.words = np.concatenate([self.words, words])
        for k, level in enumerate(self.levels):
            self.found += level.advance(self.words, self.levels[k - 1] if k else None, last)
        for k, level in enumerate(self.levels):
            level.trim(self.levels[k + 1] if k + 1 < len(self.levels) else None)

    def runs(self, least: int) -> np.ndarray:
        """(start, end, period) of the runs of at least ``least`` words by start, then period.  A stretch caught under a multiple of its period goes."""
        p, lo, hi = np.concatenate(self.found).T
        hi = hi + p
        order = np.lexsort((p, hi, lo))
        p, lo, hi = p[order], lo[order], hi[order]
        keep = np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])][: len(p)] & (hi - lo >= least)
        p, lo, hi = p[keep], lo[keep], hi[keep]
        return np.stack([lo, hi, p], 1)[np.lexsort((p, lo))]


def runs_of(lists: list[np.ndarray], least: int = 24, segment: int = 1 << 17) -> list[np.ndarray]:
    """Runs (start, end, period) of each list of word numbers, all found in one stream of the lists, each closed by a number of its own."""
    top = max((int(x.max()) for x in lists if len(x)), default=0) + 1
    sizes = np.array([len(x) + 1 for x in lists])
    stream = np.concatenate([np.r_[x, top + i] for i, x in enumerate(lists)]) if lists else np.empty(0, np.int64)
    finder = RunFinder(int(sizes.max(initial=1)))
    for at in range(0, len(stream), segment):
        finder.append(stream[at : at + segment], at + segment >= len(stream))
    if not finder.found:
        return [np.empty((0, 3), np.int64) for _ in lists]
    runs, starts = finder.runs(least), np.r_[0, np.cumsum(sizes)]
    cut = np.searchsorted(runs[:, 0], starts)
    return [runs[cut[i] : cut[i + 1]] - [starts[i], starts[i], 0] for i in range(len(lists))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def find_runs(docs: DataFrame, least: int = 24, rewrite: Callable[[int, list[bytes]], list[bytes]] | None = None, batch_chars: int = 1_500_000) -> DataFrame:
    """Of every text its words (split at ASCII white space), its runs and what is left when each run keeps its first period only.

    A run is a longest stretch of at least ``least`` words and three times its smallest period.  ``rewrite`` may change the
    words of a document (by doc_id) before.  A null or empty text has no words and collapses to an empty string; a null doc_id
    stays null and is never rewritten; repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
    Texts of about ``batch_chars`` characters share a stream; a longer text is one stream, appended in segments.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in slices((f.to_pandas() for f in frames), "text", batch_chars):
            ids = pdf["doc_id"].tolist()
            words = [t.encode("utf-8", "surrogatepass").split() for t in pdf["text"]]  # bytes are split at exactly these six characters
            if rewrite:
                words = [w if i == NULL_ID else rewrite(i, w) for i, w in zip(ids, words)]
            sizes = np.array([len(w) for w in words])
            flat = pa.array([x for w in words for x in w], pa.large_binary()).dictionary_encode()
            numbers = np.split(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes)[:-1])
            found = runs_of(numbers, least)
            collapsed = []
            for w, r in zip(words, found):
                if len(r):
                    w = [w[i] for i in np.flatnonzero(kept_words(len(w), r)).tolist()]
                collapsed.append(b" ".join(w).decode("utf-8", "surrogatepass"))
            all_runs = np.concatenate(found)
            of = pa.StructArray.from_arrays([pa.array(x) for x in (all_runs[:, 0], all_runs[:, 1] - all_runs[:, 0], all_runs[:, 2])], ["start", "length", "period"])
            offsets = pa.array(np.r_[0, np.cumsum([len(r) for r in found])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, of, type=kind), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return null_back(id_and_text(docs).mapInArrow(run, ROWS))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, then the least start, then the least period; null without runs.  Products compare exactly."""
    def compare(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        first = (a > b) | ((a == b) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
        same = (a == b) & (x["start"] == y["start"]) & (x["period"] == y["period"])
        return F.when(same, F.lit(0)).when(first, F.lit(-1)).otherwise(F.lit(1))

    return F.get(F.array_sort(runs, compare), F.lit(0))
