"""Op 3: quality classifier, a generalised additive model with pairwise interactions.

Boosting goes round the features in a cycle.  Each step fits a shallow regression tree on one binned feature to
the gradient of the log loss and adds it to that feature's lookup table; then the feature pairs that explain
most of what is left get two-dimensional tables in the same way.  A score is the sum of table entries, added
up bin by bin for whole batches, through the logistic function.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_and_text, null_back, release

FEATURES = ["log_chars", "log_words", "word_length", "symbols", "pipes", "marks", "upper", "digits", "stops", "distinct", "runs", "pairs", "line_words", "dup_lines", "long_words"]
_CLASSES = np.zeros(0x250, np.uint8)
_CLASSES[[ord(c) for c in "#*$%&<>"]] = 1
_CLASSES[ord("|")] = 2
_CLASSES[[ord(c) for c in "!?"]] = 3
_CLASSES[[i for i in range(0x250) if chr(i).isupper()]] = 4
_CLASSES[[i for i in range(0x250) if chr(i).islower()]] = 5
_CLASSES[[i for i in range(0x250) if chr(i).isdigit()]] = 6
_CLASSES[[ord(c) for c in ".,;:"]] = 7


def features(text: str) -> list[float]:
    """Numbers of the text alone; 0 where there is nothing to divide by."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.bincount(_CLASSES[np.minimum(points, 0x24F)], minlength=8)
    words = text.split()
    n = max(len(words), 1)
    letters = max(int(kind[4] + kind[5]), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    chars = len(points) - text.count(" ") - text.count("\n")
    return [
        np.log1p(len(points)),
        np.log1p(len(words)),
        chars / n,
        kind[1] / n,
        kind[2] / n,
        kind[3] / n,
        kind[4] / letters,
        kind[6] / n,
        kind[7] / n,
        len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / n,
        np.log1p(len(words) / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1),
        sum(len(w) > 40 for w in words) / n,
    ]


def _tree(grad: np.ndarray, weight: np.ndarray, depth: int, least: float) -> np.ndarray:
    """A regression tree over ordered bins: the value of each bin, from sums of gradients and weights per bin."""
    def leaf(a: int, b: int) -> None:
        value[a:b] = grad[a:b].sum() / (weight[a:b].sum() + 1.0)

    def grow(a: int, b: int, d: int) -> None:
        g, w = np.cumsum(grad[a:b]), np.cumsum(weight[a:b])
        gain = g[:-1] ** 2 / (w[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + 1)
        ok = (w[:-1] >= least) & (w[-1] - w[:-1] >= least)
        if d == 0 or not ok.any():
            return leaf(a, b)
        cut = a + 1 + int(np.argmax(np.where(ok, gain, -1)))
        grow(a, cut, d - 1)
        grow(cut, b, d - 1)

    value = np.zeros(len(grad))
    grow(0, len(grad), depth)
    return value


def _quadrants(grad: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree that cuts both features once: values over the grid, and its gain."""
    g, w = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (grad, weight))
    best, at = -1.0, (1, 1)
    for i in range(1, grad.shape[0]):
        q = [(m[i, 1:-1], m[i, -1] - m[i, 1:-1], m[-1, 1:-1] - m[i, 1:-1], m[-1, -1] - m[i, -1] - m[-1, 1:-1] + m[i, 1:-1]) for m in (g, w)]
        gain = sum(a**2 / (b + 1) for a, b in zip(*q))
        if len(gain) and gain.max() > best:
            best, at = float(gain.max()), (i, 1 + int(np.argmax(gain)))
    value = np.zeros_like(grad)
    for r in (slice(None, at[0]), slice(at[0], None)):
        for c in (slice(None, at[1]), slice(at[1], None)):
            value[r, c] = grad[r, c].sum() / (weight[r, c].sum() + 1.0)
    return value, best


class AdditiveModel:
    """Lookup tables: one for each feature, and one for each chosen pair over coarser bins."""

    def __init__(self, bins: int = 48, coarse: int = 8, rounds: int = 120, rate: float = 0.15, pairs: int = 6, least: float = 4.0):
        self.bins, self.coarse, self.rounds, self.rate, self.n_pairs, self.least = bins, coarse, rounds, rate, pairs, least
        self.base, self.tables, self.pairs, self.cuts, self.coarse_cuts = 0.0, [], [], [], []

    def _binned(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        quantiles = lambda n: [np.unique(np.quantile(x[:, f], np.arange(1, n) / n)) for f in range(x.shape[1])]
        self.cuts, self.coarse_cuts = quantiles(self.bins), quantiles(self.coarse)
        b, c = self._binned(x, self.cuts), self._binned(x, self.coarse_cuts)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(k) + 1) for k in self.cuts]
        raw = np.full(len(y), self.base)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-raw))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for f, table in enumerate(self.tables):
                g, w = slopes()
                step = self.rate * _tree(np.bincount(b[:, f], g, len(table)), np.bincount(b[:, f], w, len(table)), 2, self.least)
                table += step
                raw += step[b[:, f]]

        def grid(f: int, h: int) -> tuple[np.ndarray, tuple[int, int]]:
            shape = (len(self.coarse_cuts[f]) + 1, len(self.coarse_cuts[h]) + 1)
            return c[:, f] * shape[1] + c[:, h], shape

        g, w = slopes()
        gains = []
        for f in range(x.shape[1]):
            for h in range(f + 1, x.shape[1]):
                at, shape = grid(f, h)
                if min(shape) > 1:
                    gains.append((_quadrants(np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, w, shape[0] * shape[1]).reshape(shape))[1], f, h))
        self.pairs = [(f, h, np.zeros(grid(f, h)[1])) for _, f, h in sorted(gains, reverse=True)[: self.n_pairs]]
        for _ in range(self.rounds):
            for f, h, table in self.pairs:
                (at, shape), (g, w) = grid(f, h), slopes()
                step = self.rate * _quadrants(np.bincount(at, g, table.size).reshape(shape), np.bincount(at, w, table.size).reshape(shape))[0]
                table += step
                raw += step.ravel()[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        if self.tables and len(x):
            b, c = self._binned(x, self.cuts), self._binned(x, self.coarse_cuts)
            for f, table in enumerate(self.tables):
                raw += table[b[:, f]]
            for f, h, table in self.pairs:
                raw += table[c[:, f], c[:, h]]
        return 1 / (1 + np.exp(-raw))


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _table_of_features(docs: DataFrame, *more: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.drop(columns="text").assign(x=[np.asarray(features(t), float).tolist() for t in pdf["text"]])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInPandas(run, f"{schema}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, **how) -> AdditiveModel:
    """Fits on at most ``sample_rows`` labelled rows: those with the least hash of doc_id among the rows not held out.

    Null labels and null doc_ids are skipped, a doc_id with several labels takes the least.  Rows with equal hashes follow
    their doc_id, then their features.  Very long texts count whole.  Without any label the model scores every text 0.5.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # at most sample_rows small rows
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    # repeated doc_ids may have more rows, so the bound holds before anything is collected
    pdf = _table_of_features(rows).orderBy("doc_id", "x").limit(sample_rows).toPandas()
    model = AdditiveModel(**how)
    return model.fit(np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(float)) if len(pdf) else model


def score(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null text is empty, and an empty one has a score like any other; very long texts are read whole.  Equal texts score the
    same, so ties and repeated rows need no order.  A null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            s = model.score(np.array([features(t) for t in pdf["text"]], float).reshape(-1, len(FEATURES)))
            yield pdf.drop(columns="text").assign(score=s, predicted=(s >= threshold).astype("int32"))

    own = id_and_text(docs).select("doc_id", held_out(F.nullif("doc_id", F.lit(NULL_ID))).alias("held_out"), "text")
    return null_back(own.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int"))


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The documents that the classifier accepts, with all their columns of any name, in one pass over the texts.

    Every row is judged by its own text, also under a null or repeated doc_id; null and empty texts are scored like any other.
    An empty table stays empty.
    """
    model = train(docs, labels, **how)

    def kept(b: pa.RecordBatch) -> pa.RecordBatch:
        # one text after another, so that no batch stands in memory twice
        x = np.array([features(t.as_py() or "") for t in b.column("text")], float).reshape(-1, len(FEATURES))
        return b.filter(pa.array(model.score(x) >= threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(kept, batches)
        release()

    return docs.mapInArrow(run, docs.schema)
