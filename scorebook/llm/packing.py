"""Op 1: best-fit packing, certified by lower bounds, with exchange between partitions.

Every document becomes one piece of at most ``capacity`` ids; only longer documents are cut.  Pieces are dealt
to groups of bounded size.  Each group packs its own pieces by best fit decreasing and is certified if its number of
sequences meets the lower bound that dual feasible functions give.  The sequences with a gap in the groups that are
not certified are opened, and these groups exchange their pieces: they are dealt anew to fewer groups and packed
again.  When that gains nothing more and the whole table is still above its own bound, the sequences with a gap
in the certified groups (each may waste a part of one) are exchanged as well.  An exchange that gains nothing is undone
and ends the work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBPE, cut
from .common import id_and_text, null_back, release, stage

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences needed at least for ``counts[s]`` pieces of each size s, by two families of dual feasible functions.

    A function u is dual feasible if sizes that fit into one sequence never have u-values above ``capacity`` in
    sum.  Then the sum of all u-values over ``capacity``, rounded up, bounds the number of sequences.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    n, best = counts.astype(np.int64), 0
    for least in range(capacity // 2 + 1):
        # small pieces count nothing, those that leave no room for any other count fully
        value = np.where(size > capacity - least, capacity, np.where(size < least, 0, size))
        best = max(best, -(-int((n * value).sum()) // capacity))
    for k in range(1, 11):
        # sizes rounded down to multiples of capacity / (k + 1), except exact multiples; values in units of 1 / (k (k+1))
        exact = size * (k + 1) % capacity == 0
        value = np.where(exact, size * (k + 1) * k, size * (k + 1) // capacity * capacity * (k + 1))
        best = max(best, -(-int((n * value).sum()) // (capacity * k * (k + 1))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece.  The free room of bins is a bit set, so the tightest bin is its lowest bit from the piece's size on."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n_bins = 0, 0
    for i in order.tolist():
        size = int(lengths[i])
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            free[room - size].append(b)
            mask |= 1 << (room - size)
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document; a document is its ids and then id 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()  # what the worker held for an operator before
        bpe = ByteBPE(tokenizer_path)
        for pdf in batches:
            rows = []
            for doc_id, ids in zip(pdf["doc_id"], bpe.many(pdf["text"].tolist())):
                ids = memoryview(ids + b"\0\0\0\0")
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out

    return id_and_text(docs).mapInPandas(run, PIECES)


def with_gaps(capacity: int, certified: bool) -> F.Column:
    """Rows in sequences with a gap: of the groups above their bound only, or of the ``certified`` ones as well."""
    gap = F.col("fill") < capacity
    return gap if certified else gap & (F.col("group_bins") > F.col("group_bound"))


def pack(items: DataFrame, capacity: int = CAPACITY, group_rows: int = 25_000) -> DataFrame:
    """``items`` (columns of PIECES) with sequence_id, offset, the round that placed them and their group's figures.

    A group holds about ``group_rows`` pieces, which bounds its memory at any input size and with any ids.  Repeated
    rows are packed each by itself, a null doc_id like any other; of equal lengths any comes first; an empty table gives no rows.
    """
    schema = f"{PIECES}, round int, part long, bin long, offset long, fill long, group_bins long, group_bound long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        return pdf.assign(bin=bins, offset=offsets, fill=fill[bins], group_bins=len(fill), group_bound=lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity))[[c.split()[0] for c in schema.split(", ")]]

    items = stage(items, "pieces")
    names = items.columns

    def dealt(todo: DataFrame, rows: int, k: int) -> DataFrame:
        # by numbers of the staged rows, so that no id gathers rows in one group
        part = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(k)), F.lit(max(1, -(-rows // group_rows))))
        return stage(todo.select(*names, F.lit(k).alias("round"), part.alias("part")).groupBy("part").applyInPandas(run, schema), f"packed{k}")

    def size(df: DataFrame) -> tuple[int, int]:
        return tuple(df.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first())

    sizes = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    counts[list(sizes)] = list(sizes.values())
    bound, k = lower_bound(counts, capacity), 0
    whole = dealt(items, sum(sizes.values()), k)
    bins = size(whole)[1]
    for certified in (False, True):
        while bins > bound:
            gap = with_gaps(capacity, certified)
            rows, before = size(whole.filter(gap))
            if before < 2:
                break
            k += 1
            again = dealt(whole.filter(gap), rows, k)
            gain = before - size(again)[1]
            if gain <= 0:
                break  # ``whole`` keeps what it had
            whole, bins = whole.filter(~gap).unionByName(again), bins - gain
    number = F.shiftleft(F.col("round").cast("long"), 58) + F.shiftleft("part", 24) + F.col("bin")
    return whole.select(*names, number.alias("sequence_id"), "offset", "round", "group_bins", "group_bound")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **how) -> DataFrame:
    """Packs ``docs`` (doc_id, text; null text is empty) into sequences of at most ``capacity`` ids.

    An empty text still has its id 0 and so one piece; a very long one is cut.  Repeated rows and null ids are packed each
    by itself, ties in any order; an empty table gives no rows.  Extra columns are ignored.
    """
    return null_back(pack(pieces(docs, tokenizer_path, capacity), capacity, **how))
