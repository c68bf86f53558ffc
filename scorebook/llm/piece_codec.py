"""Op 8: SentencePiece ids and back, through a table of distinct chunks.

No piece of the model has a white-space marker after another character (``separable`` checks it), so no merge
crosses the border between a character and a following marker.  Each distinct marked word of a batch is
segmented and decoded once, and a text's ids are joined back by position.  Texts with runs of markers, and all
texts under a model that isn't separable, are segmented whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .byte_bpe import batches, gather, split_words
from .common import id_and_text, null_back

MARK = "▁"
ROWS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def separable(model) -> bool:
    """Whether cutting before each marker that follows another character leaves the ids as they are."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return not any(a != MARK and b == MARK for p in pieces for a, b in zip(p, p[1:]))


class PieceCodec:
    """(ids, decoded text) of texts, equal to the model's own ``encode`` and ``decode``."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.cuts, n = separable(self.model), self.model.get_piece_size()
        self.names = pa.array([str(i) for i in range(n)])
        self.begins = np.array([self.model.id_to_piece(i).startswith(MARK) for i in range(n)])

    def whole(self, text: str) -> tuple[int, str, str]:
        ids = self.model.encode(text, num_threads=1)
        return len(ids), ",".join(map(str, ids)), self.model.decode(ids)

    def table(self, words: list[str], at_once: int = 4000) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The distinct-chunk table: ids of all words in a row, ids of each, decoded words.  Words are joined,
        segmented and decoded ``at_once`` by one call each; an id whose piece begins with the marker begins a word."""
        ids, sizes, decoded = [], [], []
        for i in range(0, len(words), at_once):
            got = self.model.encode(" ".join(words[i : i + at_once]), num_threads=1)
            decoded += self.model.decode(got).split(" ")
            ids.append(np.array(got, np.int32))
            sizes.append(np.diff(np.flatnonzero(self.begins[got]), append=len(got)))
        return np.concatenate(ids), np.concatenate(sizes), decoded

    def many(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids in decimal joined by commas, decoded text) of each text."""
        simple = [bool(self.cuts and t and "  " not in t and MARK not in t and t[0] != " " and t[-1] != " ") for t in texts]
        some = [t for t, s in zip(texts, simple) if s]
        if some:
            words, codes, offsets = split_words(some)
            ids, sizes, decoded = self.table(words.to_pylist())
            ids, ends = gather(ids, sizes, codes, offsets)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.names.take(pa.array(ids))), ",")
            back = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(decoded).take(pa.array(codes))), " ")
            found = zip(np.diff(ends).tolist(), joined.to_pylist(), back.to_pylist())
        return [next(found) if s else self.whole(t) if t else (0, "", "") for t, s in zip(texts, simple)]


def encode_decode(docs: DataFrame, model_path: str, batch_chars: int = 4_000_000) -> DataFrame:
    """One row for each document: number of ids, and SHA-256 of the ids (decimal, joined by commas) and of the decoded text.

    Null and empty texts have no ids and decode to an empty text.  ``batch_chars`` bounds the chunk table; a very long text
    makes a batch of its own.  Repeated rows give repeated results, null ids stay null and nothing is ranked, so ties don't
    matter; an empty table gives no rows; extra columns are ignored.
    """

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = PieceCodec(model_path)
        for pdf in frames:
            rows = [(n, sha(i), sha(d)) for some in batches(pdf["text"].tolist(), batch_chars) for n, i, d in codec.many(some)]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return null_back(id_and_text(docs).mapInPandas(run, ROWS))
