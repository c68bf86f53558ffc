"""Op 7: removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes count through the threshold (100 bytes) only.  A first pass over all documents keeps those around a
32-byte block that the content designates and that repeats (``repeats``): only these can begin with a repeated
string.  They are then sorted by digits of eight bytes, the most significant first: each pass orders the suffixes of
every group by their next digit and splits it; groups of one drop out.  After the last digit, equal groups are
exactly the repeated strings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import null_column, numbered
from .repeats import byte_codes, own_bytes, removed, repeated_spans, runs, with_spans
from .substring_dedup import id_text_null

THRESHOLD, BLOCK, DIGIT = 100, 32, 8


def cut_bytes(text: bytes) -> Callable[[int, int], bytes]:
    return lambda a, b: text[a:b]


def radix_groups(texts: list[bytes], n: np.ndarray, g: np.ndarray, threshold: int) -> np.ndarray:
    """A number for each of the first ``n`` suffixes of each context, equal exactly for suffixes around one block ``g``
    that are equal through ``threshold`` bytes, in their order; -1 where a digit leaves a suffix alone."""
    raw = b"".join(texts) + b"\0" * DIGIT
    digits = np.ndarray((len(raw) - DIGIT + 1,), ">u8", raw, strides=(1,))  # the digit that begins at each byte
    begins = np.cumsum([0, *map(len, texts)])[:-1]
    of = np.repeat(np.arange(len(n)), n)
    at = begins[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    group, alive, now = np.full(len(of), -1, np.int64), np.arange(len(of)), g[of].astype(np.int64)
    for depth in range(0, threshold, DIGIT):
        digit = digits[at[alive] + depth].astype(np.uint64) >> np.uint64(8 * max(depth + DIGIT - threshold, 0))
        order = np.lexsort((digit, now))
        alive, digit, now = alive[order], digit[order], now[order]
        if not len(alive):
            break
        number = np.cumsum(runs(now, digit)) - 1
        again = np.bincount(number)[number] > 1
        alive, now = alive[again], number[again]
    group[alive] = now
    return group


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    if not len(gone):
        return text
    edges = [0, *gone.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2]))


def _spans(known: DataFrame, threshold: int, **how) -> DataFrame:
    return repeated_spans(known, byte_codes, cut_bytes, radix_groups, threshold, min(BLOCK, max(threshold // 3, 1)), **how)


def dedup_bytes(docs: DataFrame, threshold: int = THRESHOLD, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, end of removed byte runs) and kept (the bytes left).

    A byte goes if a string of ``threshold`` bytes over it also starts earlier, in a smaller doc_id or before in the
    same document.  Null text is empty.  A null doc_id counts as smaller than any other, and each row with one is a
    document of its own.  Equal rows under one doc_id are one document and keep the same bytes; different texts under
    one doc_id are documents of their own, in the order of a hash of them.  Of equal strings the first in this order
    stays, so there are no ties.  Very long texts are hashed in parts.  An empty table gives no rows; other columns are ignored.
    """
    known = numbered(docs.select("doc_id", "text"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = own_bytes(pdf["text"])
        gone = [removed(s, len(t), threshold) for t, s in zip(texts, pdf["_spans"])]
        out = pd.DataFrame({"n_bytes": [len(t) for t in texts], "n_removed": [int((g[:, 1] - g[:, 0]).sum()) for g in gone], "n_spans": [len(g) for g in gone], "spans": [g.ravel().tolist() for g in gone], "kept": [_kept(t, g) for t, g in zip(texts, gone)]})
        out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
        return out.assign(_null=pdf["_null"].to_numpy())

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary, _null boolean"
    own = with_spans(known, _spans(known, threshold, **how)).select(*id_text_null(), "_spans")
    return null_column(own.mapInPandas(lambda batches: map(work, batches), schema))


def dedup_documents(docs: DataFrame, threshold: int = THRESHOLD, **how) -> DataFrame:
    """``docs`` with all columns; the repeated strings are taken out of text (a character cut in two goes whole), and
    n_chars, if there, counts the new text.

    Ids and order are as in ``dedup_bytes``.  A null text stays null; a document whose text is all repeats keeps an empty
    one; no row is dropped.  Other columns, of any name, are left as they are.
    """
    known, names = numbered(docs), docs.columns

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        row, kept = b.column("row"), []
        old = dict(zip(names, row.flatten()))
        for t, s in zip(old["text"].to_pylist(), b.column("_spans")):
            if t is None or not s.is_valid:
                kept.append(t)
                continue
            raw = t.encode("utf-8", "surrogatepass")
            kept.append(_kept(raw, removed(s.values.to_numpy(), len(raw), threshold)).decode("utf-8", "ignore"))
        new = {"text": pa.array(kept, old["text"].type)}
        if "n_chars" in names:
            new["n_chars"] = pa.array([None if k is None else len(k) for k in kept], old["n_chars"].type)
        return pa.RecordBatch.from_arrays([new.get(c, old[c]) for c in names], names=names)

    return with_spans(known, _spans(known, threshold, **how)).mapInArrow(lambda batches: map(work, batches), docs.schema)
