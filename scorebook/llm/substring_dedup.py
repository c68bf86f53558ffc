"""Op 5: removal of repeated word passages by level-wise doubling.

Level one goes over all documents: windows are represented by designated blocks of a quarter of their length, and
those whose block occurs once drop out (``repeats``).  What repeats there alone is extended: the next level compares
half windows, the one after it whole windows, and at each level what occurs once drops out before lengths double
again.  Windows are told apart by 64-bit hashes within their block's group.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_column, numbered
from .repeats import Prefix, own_bytes, removed, repeated_spans, runs, with_spans, word_codes

WINDOW = 20


def cut_words(text: bytes) -> Callable[[int, int], bytes]:
    words = text.split()
    return lambda a, b: b" ".join(words[a:b])


def levels(window: int) -> list[int]:
    """Lengths that double up to ``window``, from about a quarter of it on."""
    return [-(-window // 4), -(-window // 2), window]


def doubled(texts: list[bytes], n: np.ndarray, g: np.ndarray, window: int) -> np.ndarray:
    """A number for each of the first ``n`` windows of each context, equal for equal windows around one block ``g``, and
    -1 where no level leaves another candidate."""
    x, counts = word_codes(texts)
    of = np.repeat(np.arange(len(n)), n)
    at = (np.cumsum(counts) - counts)[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    hashes, group = Prefix(x), np.full(len(of), -1, np.int64)
    alive, now = np.arange(len(of)), g[of].astype(np.int64)
    for length in levels(window):
        h = hashes.hash(at[alive], at[alive] + length)
        order = np.lexsort((h, now))
        alive, h, now = alive[order], h[order], now[order]
        if not len(alive):
            break
        number = np.cumsum(runs(now, h)) - 1
        again = np.bincount(number)[number] > 1  # what occurs once is not extended
        alive, now = alive[again], number[again]
    group[alive] = now
    return group


def dedup_words(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """doc_id, n_words, n_removed, spans (start, end of removed word runs) and kept (the words left, joined by one space).

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word goes if a window of ``window`` words over it also starts earlier, in a
    smaller doc_id or before in the same document.  Null and empty texts have no words.  A null doc_id counts as
    smaller than any other, and each row with one is a document of its own.  Equal rows under one doc_id are one
    document and keep the same words; different texts under one doc_id are documents of their own, in the order of a
    hash of them.  Of equal windows the first in this order stays, so there are no ties.  Very long texts are hashed in parts.
    An empty table gives no rows; other columns are ignored.
    """
    known = numbered(docs.select("doc_id", "text"))
    spans = repeated_spans(known, word_codes, cut_words, doubled, window, levels(window)[0], **how)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text, mine in zip(own_bytes(pdf["text"]), pdf["_spans"]):
            words = text.split()
            gone = removed(mine, len(words), window)
            keep = words
            if len(gone):
                left = np.ones(len(words), bool)
                for a, b in gone:
                    left[a:b] = False
                keep = compress(words, left.tolist())
            rows.append((len(words), int((gone[:, 1] - gone[:, 0]).sum()), gone.ravel().tolist(), b" ".join(keep).decode("utf-8", "replace")))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "spans", "kept"])
        out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
        return out.assign(_null=pdf["_null"].to_numpy())

    schema = "doc_id long, n_words long, n_removed long, spans array<long>, kept string, _null boolean"
    own = with_spans(known, spans).select(*id_text_null(), "_spans")
    return null_column(own.mapInPandas(lambda batches: map(work, batches), schema))


def id_text_null() -> list:
    """doc_id (0 for null), text and whether doc_id was null, from ``row``."""
    found = F.col("row.doc_id").cast("long")
    return [F.coalesce(found, F.lit(0).cast("long")).alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"), found.isNull().alias("_null")]
