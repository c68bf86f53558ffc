"""Byte-level BPE ids, and the table of distinct words that the piece codec uses.

The merges are the vocabulary file's own; the fast encoder gets them as ranks and gives the same ids.  Texts that
hold a special token's string go to the file's own library, which makes one id of it.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the split pattern of the vocabulary file's byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable bytes stand for themselves, the
    others take the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """ids of whole texts, equal to ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        at = _byte_of_char()
        ranks = {bytes(at[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.plain = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._slow = None

    def one(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self.path)
            return self._slow.encode(text, add_special_tokens=False).ids
        return self.plain.encode_ordinary(text)

    def many(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, in order."""
        for t in texts:
            yield array("I", self.one(t)).tobytes()


def batches(texts: list[str], chars: int) -> Iterator[list[str]]:
    """``texts`` in order, in lists of about ``chars`` characters."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > chars:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words between single spaces, the code of every word, where each text's words begin)."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)


def gather(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the ids of words by position: (all ids, where each text's begin).  ``sizes`` are the ids of each distinct word."""
    n = sizes[codes]
    upto = np.concatenate([[0], np.cumsum(n)])
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1][codes]
    return ids[np.repeat(starts - upto[:-1], n) + np.arange(upto[-1])], upto[offsets]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all of ``capacity`` ids except perhaps the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []
