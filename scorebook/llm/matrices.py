"""Op 6: packed id matrices by best fit decreasing with a segment tree over the free room.

Each task packs its own documents, in chunks of bounded size, so ids never cross the network.  A document that
is longer than a row is cut losslessly; its pieces say where they start.  Every row of the matrix comes with
cumulative segment lengths and with positions that restart at each segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBPE, cut
from .common import NULL_ID, id_and_text

CAPACITY = 2048
ROWS = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, pieces array<int>, starts array<long>"


class RoomTree:
    """Segment tree over room 0..capacity; a node counts the rows whose free room lies below it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) with the least room of at least ``size``; the row leaves the tree."""
        node = self.leaves + size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def fill_rows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items of each row, by best fit decreasing."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room, row = tree.take(lengths[i]) or (capacity, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        tree.put(room - lengths[i], row)
    return rows


def packed_matrices(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, chunk_tokens: int = 4_000_000) -> DataFrame:
    """One row for each packed row of the id matrix; ids and positions are little-endian 32-bit integers.

    ``chunk_tokens`` bounds what a task holds before it packs.  Null text is empty and gives ``end_id`` alone; a very long
    text is cut without loss.  Repeated rows and null ids are packed each by itself, ties in input order; an empty table
    gives no rows; extra columns are ignored.
    """

    def emit(held: list, task: int, serial: int) -> pd.DataFrame:
        out = []
        for row in fill_rows([len(x[3]) // 4 for x in held], capacity):
            got = [held[i] for i in row]
            lens = [len(x[3]) // 4 for x in got]
            ends = np.cumsum([0, *lens]).astype(np.int32)
            positions = np.concatenate([np.arange(n, dtype="<i4") for n in lens])
            out.append(((task << 32) + serial + len(out), int(ends[-1]), b"".join(x[3] for x in got), ends.tolist(), positions.tobytes(), [x[0] for x in got], [x[1] for x in got], [x[2] for x in got]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        bpe, task, held, tokens, serial = ByteBPE(tokenizer_path), TaskContext.get().partitionId(), [], 0, 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            for doc_id, ids in zip(pdf["doc_id"].tolist(), bpe.many(pdf["text"].tolist())):
                ids += end
                doc_id = None if doc_id == NULL_ID else doc_id
                held += [(doc_id, k, s, ids[4 * s : 4 * (s + n)]) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
                tokens += len(ids) // 4
                if tokens >= chunk_tokens:
                    out = emit(held, task, serial)
                    serial, held, tokens = serial + len(out), [], 0
                    yield out
        if held:
            yield emit(held, task, serial)

    return id_and_text(docs).mapInPandas(run, ROWS)


def write_matrices(matrices: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Writes the matrices to ``path`` as Parquet and reads them back: in every row ``capacity`` ids (padded by ``end_id``) and
    positions (padded by 0) as fixed-size little-endian 32-bit values, and the cumulative segment lengths without the padding.

    The executors write their own rows; an empty table gives files without rows.
    """
    pad = np.array([end_id], dtype="<u4").tobytes()
    wide = lambda c, fill: F.substring(F.concat(c, F.lit(bytearray(fill * capacity))), 1, 4 * capacity).alias(c)
    kept = [c for c in matrices.columns if c not in ("ids", "positions")]
    matrices.select(*kept, wide("ids", pad), wide("positions", b"\0" * 4)).write.option("compression", "zstd").parquet(path)
    return matrices.sparkSession.read.parquet(path)


def digests(written: DataFrame) -> DataFrame:
    """Rows of written matrices without the ids themselves: sums over the padded rows that prove them."""
    return written.select("sequence_id", "n_tokens", F.size("doc_ids").alias("n_segments"), "cu_seqlens", "doc_ids", "pieces", "starts", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))
