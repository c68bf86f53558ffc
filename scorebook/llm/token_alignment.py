"""Op 12: two tokenizers' ids of the same bytes, aligned, and how often the corpus links each pair of ids.

In a batch ``merge_asof``, keyed by document, finds for each token start the other side's token that covers it, once in each
direction.  Both directions together are all overlaps, in the order of their starts; where both sides start at once, both ended
before, so a group begins.  A batch travels as one block: ids and one step of two bits for each link (which side's token begins there).

Texts pass the shuffle once, as blocks.  A block asks for the counts of just the pairs it links, so the table of all pairs is never in
one place, neither broadcast nor collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import ByteBPE, gather, split_words
from .common import id_and_text, null_back, partitions, slices
from .piece_codec import MARK, PieceCodec

BLOCK = "chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_links array<long>, a binary, b binary, steps binary"
ASKS = "chunk long, a int, b int, docs long"
ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
_SPACES = re.compile(r"^\s| \s")


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd"), kind) if n else np.empty(0, kind)


class Aligner:
    """Both sides' ids of texts, and the overlaps of their tokens."""

    def __init__(self, bpe_path: str, model_path: str):
        self.bpe, self.codec = ByteBPE(bpe_path), PieceCodec(model_path)
        model, known = self.codec.model, dict.fromkeys(self.bpe.plain.token_byte_values())
        a = [b""] * self.bpe.plain.n_vocab
        for token in known:
            a[self.bpe.plain.encode_single_token(token)] = token
        names = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
        b = [bytes([int(p[3:5], 16)]) if one else p.replace(MARK, " ").encode() for p, one in names]
        self.bytes = [pa.array(x, pa.large_binary()) for x in (a, b)]
        self.sizes = [np.array([len(t) for t in x], np.int64) for x in (a, b)]

    def words_a(self, words: list[str], at_once: int = 4000) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, ids of each), each word after a space; they don't depend on the words around."""
        ids, sizes = [], []
        for i in range(0, len(words), at_once):
            some = words[i : i + at_once]
            got = self.bpe.plain.encode_to_numpy(" " + " ".join(some)).astype(np.int64)
            upto = np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 1 for w in some])
            ids.append(got)
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.sizes[0][got]), upto) + 1, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def words_b(self, words: list[str], at_once: int = 4000) -> tuple[np.ndarray, np.ndarray]:
        """The same on side B, where an id whose piece begins with the marker begins a word."""
        ids, sizes = [], []
        for i in range(0, len(words), at_once):
            got = np.array(self.codec.model.encode(" ".join(words[i : i + at_once]), num_threads=1), np.int64)
            ids.append(got)
            sizes.append(np.diff(np.flatnonzero(self.codec.begins[got]), append=len(got)))
        return np.concatenate(ids), np.concatenate(sizes)

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text on side A (of a space and the text) and on side B (which adds the space).  Where both cut at single spaces, each distinct
        word is encoded once."""
        simple = [bool(self.codec.cuts and t and "  " not in t and MARK not in t and t[-1] != " " and not _SPACES.search(t)) for t in texts]
        some, found = [t for t, s in zip(texts, simple) if s], None
        if some:
            words, codes, offsets = split_words(some)
            words = words.to_pylist()
            tables = self.words_a(words), self.words_b(words)
            both = [gather(ids, sizes, codes, offsets) for ids, sizes in tables]
            found = zip(*(np.split(ids, upto[1:-1]) for ids, upto in both))
        a, b = [], []
        for t, s in zip(texts, simple):
            x, y = next(found) if s else (self.bpe.plain.encode_to_numpy(" " + t), self.codec.model.encode(t, num_threads=1)) if t else ((), ())
            a.append(np.asarray(x, np.int64))
            b.append(np.asarray(y, np.int64))
        return a, b

    def true_ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """``ids``, but none of a text of which either side's tokens don't spell a space and the text."""
        a, b = self.ids(texts)
        want = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        none = np.empty(0, np.int64)
        spelt = [self.spell(k, ids) for k, ids in enumerate((a, b))]
        good = [x == y == w for x, y, w in zip(*spelt, want)]
        return [x if g else none for x, g in zip(a, good)], [x if g else none for x, g in zip(b, good)]

    def spell(self, side: int, ids: list[np.ndarray]) -> list[bytes]:
        flat = np.concatenate(ids)
        data = self.bytes[side].take(pa.array(flat)).buffers()[2]
        data = data.to_pybytes() if data else b""
        upto = _ends(self.sizes[side][flat])[_ends([len(x) for x in ids])].tolist()
        return [data[s:e] for s, e in zip(upto, upto[1:])]

    def steps(self, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(steps of all links in order, links of each document): 1 where an A token begins, 2 a B token, 3 both."""
        frames = []
        for side, ids in enumerate((a, b)):
            doc, flat = np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.concatenate(ids)
            ends = np.cumsum(self.sizes[side][flat])
            # both sides of a document have equal bytes, so positions counted through the batch keep documents apart and in order
            frames.append(pd.DataFrame({"at": ends - self.sizes[side][flat], "doc": doc, "own": np.arange(len(flat))}))
        one, two = frames
        covers_a = pd.merge_asof(one, two, on="at", by="doc")  # own_x begins inside or at the start of own_y
        covers_b = pd.merge_asof(two, one, on="at", by="doc")
        starts_a = one["at"].to_numpy()
        new = covers_b[starts_a[covers_b["own_y"].to_numpy()] < covers_b["at"].to_numpy()]  # the others are in covers_a
        both = two["at"].to_numpy()[covers_a["own_y"].to_numpy()] == covers_a["at"].to_numpy()
        at = np.concatenate([covers_a["at"].to_numpy(), new["at"].to_numpy()])
        step = np.concatenate([1 + 2 * both, np.full(len(new), 2)]).astype(np.uint8)
        links = np.bincount(np.concatenate([covers_a["doc"], new["doc"]]).astype(np.int64), minlength=len(a))
        return step[np.argsort(at, kind="stable")], links

    def block(self, texts: list[str]) -> tuple[list, list, list, bytes, bytes, bytes]:
        a, b = self.true_ids(texts)
        step, links = self.steps(a, b)
        n_a, n_b = ([len(x) for x in ids] for ids in (a, b))
        return n_a, n_b, links.tolist(), _pack(np.concatenate(a).astype(np.uint32)), _pack(np.concatenate(b).astype(np.uint32)), _pack(step)


class Block:
    """A block read back: ids, steps, and the ids of both ends of every link."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.n_a, self.n_b, self.n_links = (np.array(row[c], np.int64) for c in ("n_a", "n_b", "n_links"))
        self.a, self.b = (_unpack(row[c], int(n.sum()), np.uint32) for c, n in (("a", self.n_a), ("b", self.n_b)))
        self.steps = _unpack(row["steps"], int(self.n_links.sum()), np.uint8)
        self.link_a, self.link_b = (side[np.cumsum(self.steps >> k & 1, dtype=np.int64) - 1].astype(np.int64) for k, side in ((0, self.a), (1, self.b)))

    def keys(self) -> np.ndarray:
        return self.link_a << 32 | self.link_b

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct linked pairs, how many documents of the block link each)."""
        known, code = np.unique(self.keys(), return_inverse=True)
        doc = np.repeat(np.arange(len(self.n_links)), self.n_links)
        each = np.unique(code + doc * max(len(known), 1))
        return known, np.bincount(each % max(len(known), 1), minlength=len(known))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of a value of each link the sum over each document."""
        return np.diff(_ends(values)[_ends(self.n_links)])

    def groups(self) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3``: ids of both sides by group."""
        begins = self.steps == 3
        group_a, group_b = (np.cumsum(begins)[(self.steps >> k & 1) == 1] for k in (0, 1))  # of each token, from 1 through the block
        # a token stands after the other side's tokens of earlier groups, B's also after its own group's A tokens
        at_a = np.arange(len(self.a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(self.b)) + np.searchsorted(group_a, group_b, "right")
        text, where = pa.array(np.concatenate([self.a, self.b])).cast(pa.string()), np.empty(len(at_a) + len(at_b), np.int64)
        where[at_a], where[at_b] = np.arange(len(at_a)), len(at_a) + np.arange(len(at_b))
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (group_a, group_b))
        sign = np.concatenate([np.where(last_a, "|", ","), np.where(last_b, ";", ",")])
        ends = _ends(self.n_b)[1:] - 1
        sign[len(at_a) + ends[self.n_b > 0]] = ""
        joined = pc.binary_join_element_wise(text.take(pa.array(where)), pa.array(sign[where]), "")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(_ends(self.n_a + self.n_b), pa.int32()), joined), "")


def align(docs: DataFrame, bpe_path: str, model_path: str, batch_chars: int = 2_000_000) -> DataFrame:
    """Of each text the tokens of both sides, groups (stretches of bytes that both sides cut out), links (pairs of tokens that share bytes), links
    whose pair of ids the most documents hold among all of their A id (``n_best``; ties count), and the documents that hold
    each link's pair, summed over the links (``count_sum``).

    A null or empty text, and one that either side doesn't spell, has no tokens: all numbers are 0 and the groups empty.  A null doc_id stays null;
    every row counts as a document, repeated ones too; an empty table gives no rows; extra columns are ignored.
    A very long text makes a block of its own.
    """
    n = partitions(docs.sparkSession)

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, task = Aligner(bpe_path, model_path), TaskContext.get().partitionId()
        kinds = [pa.int64(), *(pa.list_(pa.int64()),) * 4, *(pa.binary(),) * 3]
        for k, pdf in enumerate(slices((f.to_pandas() for f in frames), "text", batch_chars)):
            row = (task << 32 | k, pdf["doc_id"].tolist(), *side.block(pdf["text"].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], [c.split()[0] for c in BLOCK.split(", ")])

    def ask(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for row in f.to_pylist():
                known, found = Block(row).pairs()
                columns = [pa.array(np.full(len(known), row["chunk"])), pa.array((known >> 32).astype(np.int32)), pa.array((known & 0xFFFFFFFF).astype(np.int32)), pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "a", "b", "docs"])

    def answer(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        a, b, held, best = (counts[c].to_numpy() for c in ("a", "b", "held", "best"))
        known = a.astype(np.int64) << 32 | b
        order, out = np.argsort(known), []
        known, held, best = np.append(known[order], -1), np.append(held[order], 0), np.append(best[order], False)
        for row in blocks.to_pylist():
            block = Block(row)
            at = np.searchsorted(known[:-1], block.keys())
            if not (known[at] == block.keys()).all():
                raise RuntimeError("a block was computed again with other texts")
            numbers = [block.n_a, block.n_b, block.sums(block.steps == 3), block.n_links, block.sums(best[at]), block.sums(held[at])]
            columns = [pa.array(block.doc_ids, pa.int64()), *(pa.array(x.astype(np.int64)) for x in numbers), block.groups()]
            out.append(pa.table(columns, [c.split()[0] for c in ROWS.split(", ")]))
        return pa.concat_tables(out) if out else blocks.schema.empty_table()

    blocks = id_and_text(docs).mapInArrow(encode, BLOCK).repartition(n, "chunk")
    asked = blocks.mapInArrow(ask, ASKS).repartition(n, "a", "b")
    held = asked.groupBy("a", "b").agg(F.sum("docs").alias("held"))
    held = held.withColumn("best", F.col("held") == F.max("held").over(Window.partitionBy("a")))
    told = asked.join(held, ["a", "b"]).select("chunk", "a", "b", "held", "best")
    return null_back(blocks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(answer, ROWS))
