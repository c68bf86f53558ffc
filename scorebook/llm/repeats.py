"""Windows of tokens that repeat anywhere in a corpus: what is common to both exact removals of repeats.

A window is L tokens in a row.  Inside each window the k-token block with the least hash is designated, so equal
windows designate equal blocks at equal places, and neighbouring windows mostly share one.  A document is therefore
a short list of anchors (designated blocks), each with a run of windows and a context (all tokens of those windows).

First pass, over all documents: anchors are dealt by the hash of their block.  A block that occurs once drops out
with all its windows.  Of anchors with the same whole context only the first keeps its windows; all others repeat it.
Second pass, only around blocks with several contexts: the texts of these contexts are dealt by the block, and
the operator's own method (levels of doubled lengths, or digits of a radix sort) finds the equal windows in each group.

What crosses the network are packed arrays, one row for each task and bucket.  A task sends each context once,
so a passage that fills a third of the corpus arrives as one anchor from each task.  A block that one task meets in
many contexts is hot: its anchors are dealt by their contexts, with one marker for the block's own bucket, and its
windows by their own hashes.  Blocks, contexts and hot windows are told apart by hashes of 96 bits (block and
context, or block and window), all other windows by their tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, by_bucket, characters, release, slices, stage, texts_of

M = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
M_INV = pow(M, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_CODES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}
CHUNK = 1_000_000  # tokens hashed at once


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    got = _POWERS.get(base)
    if got is None or len(got) <= n:
        factors = np.full(max(n, CHUNK) + 1, base, np.uint64)
        factors[0] = 1
        got = _POWERS[base] = np.multiply.accumulate(factors)
    return got[: n + 1]


class Prefix:
    """Hashes of any ranges of one token array."""

    def __init__(self, x: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(M_INV, len(x))[: len(x)], dtype=np.uint64)])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * powers(M, len(self.sums))[a] + (b - a).astype(np.uint64))


def byte_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all bytes in a row, bytes of each text)."""
    return _CODES[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words in a row, words of each text); words are what ``bytes.split()`` gives."""
    counts, codes = [], []
    for group in _grouped(texts, CHUNK):
        if len(group) == 1 and len(group[0]) > CHUNK:  # a very long text: by parts that end at white space
            parts, t, at = [], group[0], 0
            while at < len(t):
                end = at + CHUNK
                while end < len(t) and not _SPACES[t[end]]:
                    end += 1
                parts.append(t[at:end])
                at = end
        else:
            parts = group
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        space = _SPACES[raw]
        edges = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
        starts, ends = edges[0::2], edges[1::2]
        n = min(len(starts), len(ends))
        starts, ends = starts[:n], ends[:n]
        codes.append(Prefix(_CODES[raw]).hash(starts, ends))
        upto = np.cumsum([len(p) + 1 for p in parts])
        each = np.diff(np.searchsorted(starts, upto), prepend=0)
        counts += [int(each.sum())] if parts is not group else each.tolist()
    return np.concatenate(codes) if codes else np.zeros(0, np.uint64), np.array(counts, np.int64)


def _grouped(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def block_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-token blocks, by doubling: a block is two blocks of half its length, or one and a token."""
    done, size, run, length = None, 0, x, 1
    while k:
        if k & 1:
            if done is None:
                done, size = run, length
            else:
                n = len(run) - size
                done = done[:n] * np.uint64(pow(M, length, 1 << 64)) + run[size : size + n]
                size += length
        k >>= 1
        if k:
            run = run[:-length] * np.uint64(pow(M, length, 1 << 64)) + run[length:]
            length *= 2
    return done


def anchors(x: np.ndarray, counts: np.ndarray, window: int, block: int) -> dict[str, np.ndarray]:
    """Anchors of the documents whose tokens stand in ``x`` in a row: doc (its place), lo (first window), n (windows),
    g (hash of the block) and c (hash of the context)."""
    width, ends = window - block + 1, np.cumsum(counts)
    if len(x) < window:
        return {k: np.zeros(0, t) for k, t in (("doc", np.int64), ("lo", np.int64), ("n", np.int64), ("g", np.uint64), ("c", np.uint64))}
    g = mix(block_hashes(x, block))
    least = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - window + 1, 0))
    begin = (ends - counts)[doc]
    first = np.repeat(np.cumsum(np.maximum(counts - window + 1, 0)) - np.maximum(counts - window + 1, 0), np.maximum(counts - window + 1, 0))
    at = begin + np.arange(len(doc)) - first  # places of all windows that lie inside one document
    if not len(at):
        return anchors(x[:0], counts[:0], window, block)
    place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    lo, n, s = at[head], np.diff(head, append=len(at)), place[head]
    c = mix(Prefix(x).hash(lo, lo + n - 1 + window) + mix((s - lo).astype(np.uint64)))
    return {"doc": doc[head], "lo": lo - begin[head], "n": n, "g": g[s], "c": c}


def segments(x: np.ndarray, counts: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Cuts the token row into parts of about CHUNK tokens: (tokens, tokens of each piece, document of each piece, its
    offset there).  Pieces of a long document overlap, so that each window is in exactly one."""
    begin, held, size = 0, [], 0

    def give():
        return np.concatenate([x[a:b] for _, _, a, b in held]), np.array([b - a for _, _, a, b in held]), np.array([d for d, _, _, _ in held]), np.array([o for _, o, _, _ in held])

    for d, n in enumerate(counts.tolist()):
        for o in range(0, max(n - window + 1, 0), CHUNK):
            a, b = begin + o, begin + min(n, o + CHUNK + window - 1)
            if held and size + b - a > CHUNK:
                yield give()
                held, size = [], 0
            held.append((d, o, a, b))
            size += b - a
        begin += n
    if held:
        yield give()


def low6(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from6(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def later_copies(order: np.ndarray, new: np.ndarray, doc_ids: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Of sorted rows, those that are later than the first of their run (a repeated row is not later)."""
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return (doc_ids[order] != doc_ids[head]) | (lo[order] != lo[head])


def span(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First window and number of windows in one number."""
    return lo.astype(np.int64) << 16 | n.astype(np.int64)


def own_bytes(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def merged(ids: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single windows, sorted by document and place, as runs (id, lo, n) of at most 65535."""
    order = np.lexsort((lo, ids))
    ids, lo = ids[order], lo[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (lo[1:] != lo[:-1] + 1)
    head = np.flatnonzero(new)
    size = np.diff(head, append=len(ids))
    i, a = ids[head], lo[head]
    while (size > 0xFFFF).any():
        big = size > 0xFFFF
        i, a, size = np.concatenate([i, i[big]]), np.concatenate([a, a[big] + 0xFFFF]), np.concatenate([np.minimum(size, 0xFFFF), size[big] - 0xFFFF])
    return i, a, size


def split_sorted(keys: np.ndarray) -> list[np.ndarray]:
    """The places of each key, in stable order."""
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.flatnonzero(runs(keys[order]))[1:]) if len(order) else []


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def pack_anchors(a: dict[str, np.ndarray], buckets: int, hot_here: int) -> list[tuple]:
    """Rows (bucket, kind, ids, counts, lo, n, g, c) of the anchors that one task holds.

    Kinds: 0 the first of each context, by its block; 1 later copies, which are settled, by their documents; 2 the first of each context
    of a block with more than ``hot_here`` contexts, by the context; 3 such blocks, as markers in their own buckets.
    """
    order = np.lexsort((a["lo"], a["id"], a["c"], a["g"]))
    g, c = a["g"][order], a["c"][order]
    new_g, new = runs(g), runs(g, c)
    late = later_copies(order, new, a["id"], a["lo"])
    hot = (np.bincount(np.cumsum(new_g) - 1, new)[np.cumsum(new_g) - 1] > hot_here) if len(g) else new
    rows = []
    for kind, part in ((0, order[~late & ~hot]), (1, order[late]), (2, order[~late & hot])):
        part = part[np.lexsort((a["lo"][part], a["id"][part]))]
        b = bucket_of(mix(a["g"][part] ^ a["c"][part]) if kind == 2 else mix(a["id"][part].astype(np.uint64)) if kind == 1 else a["g"][part], buckets)
        for at in split_sorted(b):
            p = part[at]
            head = np.flatnonzero(runs(a["id"][p]))
            rows.append((int(b[at[0]]), kind, a["id"][p[head]].tobytes(), np.diff(head, append=len(p)).astype("<u4").tobytes(), a["lo"][p].astype("<u4").tobytes(), a["n"][p].astype("<u2").tobytes(), b"" if kind == 1 else low6(a["g"][p]), b"" if kind == 1 else low6(a["c"][p])))
    marked = np.unique(g[hot])
    for at in split_sorted(bucket_of(marked, buckets)):
        rows.append((int(bucket_of(marked[at[:1]], buckets)[0]), 3, b"", b"", b"", b"", low6(marked[at]), b""))
    return rows


def settle_anchors(pdf: pd.DataFrame, hot_contexts: int) -> pd.DataFrame:
    """One bucket of packed anchors: later copies (ask false), and runs whose block occurs in several contexts (ask true)."""
    kinds = pdf["kind"].to_numpy()
    marked = from6(b"".join(pdf["g"][kinds == 3]))
    pdf = pdf[kinds != 3]
    ids = np.concatenate([np.zeros(0, np.int64), *(np.repeat(np.frombuffer(i, "<i8"), np.frombuffer(c, "<u4")) for i, c in zip(pdf["ids"], pdf["counts"]))])
    lo = np.frombuffer(b"".join(pdf["lo"]), "<u4").astype(np.int64)
    n = np.frombuffer(b"".join(pdf["n"]), "<u2").astype(np.int64)
    kind = np.repeat(pdf["kind"].to_numpy(), [len(x) // 4 for x in pdf["lo"]])
    known, rest = np.flatnonzero(kind == 1), np.flatnonzero(kind != 1)
    g, c = (from6(b"".join(pdf[k])) for k in "gc")
    order = np.lexsort((lo[rest], ids[rest], c, g))
    new_g, new = runs(g[order]), runs(g[order], c[order])
    late = later_copies(order, new, ids[rest], lo[rest])
    contexts = np.bincount(np.cumsum(new_g) - 1, new, minlength=int(new_g.sum()))[np.cumsum(new_g) - 1]
    elsewhere = (kind[rest[order]] == 2) | np.isin(g[order], marked)
    asking = new & ((contexts > 1) | elsewhere)
    ask, gone = rest[order[asking]], np.concatenate([known, rest[order[late]]])
    out = pd.DataFrame({"_id": ids[np.concatenate([gone, ask])], "span": span(lo, n)[np.concatenate([gone, ask])]})
    block = np.concatenate([np.zeros(len(gone), np.int64), g[order[asking]].astype(np.int64)])
    hot = np.concatenate([np.zeros(len(gone), bool), ((contexts > hot_contexts) | elsewhere)[asking]])
    return out.assign(ask=np.arange(len(out)) >= len(gone), g=block, hot=hot)


def pack_contexts(ids: np.ndarray, lo: np.ndarray, n: np.ndarray, g: np.ndarray, raw: list[bytes], buckets: int) -> list[tuple]:
    """Rows (bucket, kind 0, ids, lo, n, g, texts, sizes) of runs with the texts of their contexts, by their blocks."""
    rows, b = [], ((g >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
    for s in split_sorted(b):
        own = [raw[i] for i in s.tolist()]
        rows.append((int(b[s[0]]), 0, ids[s].tobytes(), lo[s].astype("<u4").tobytes(), n[s].astype("<u2").tobytes(), low6(g[s]), b"".join(own), np.array([len(x) for x in own], "<u4").tobytes()))
    return rows


def pack_hot(ids: np.ndarray, lo: np.ndarray, g: np.ndarray, w: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of single windows around hot blocks: kind 1 the first of each hash, by the hash; kind 2 runs of later copies, which are settled."""
    order = np.lexsort((lo, ids, w, g))
    late = later_copies(order, runs(g[order], w[order]), ids, lo)
    first, rows = order[~late], []
    b = ((w[first] >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
    for at in split_sorted(b):
        s = first[at]
        rows.append((int(b[at[0]]), 1, ids[s].tobytes(), lo[s].astype("<u4").tobytes(), np.ones(len(s), "<u2").tobytes(), low6(g[s]), low6(w[s]), b""))
    i, a, size = merged(ids[order[late]], lo[order[late]])
    b = (mix(i.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    for s in split_sorted(b):
        rows.append((int(b[s[0]]), 2, i[s].tobytes(), a[s].astype("<u4").tobytes(), size[s].astype("<u2").tobytes(), b"", b"", b""))
    return rows


PACKED_ANCHORS = "bucket int, kind int, ids binary, counts binary, lo binary, n binary, g binary, c binary"
PACKED_CONTEXTS = "bucket int, kind int, ids binary, lo binary, n binary, g binary, texts binary, sizes binary"


def repeated_spans(known: DataFrame, codes: Callable, cutter: Callable, equal: Callable, window: int, block: int, held_anchors: int = 500_000, hot_contexts: int = 1_000, hot_here: int = 64) -> DataFrame:
    """(_id, _spans): for each document with windows that also start earlier, those windows as packed ``span`` numbers.

    Earlier is a smaller number in ``known`` (the result of ``numbered``), or the same document and an earlier start.
    ``codes`` turns texts into tokens, ``cutter`` a text into a function that gives the text of a range of tokens.
    ``equal(texts, n, g, window)`` is the operator's method: numbers for all windows of some contexts in a row, the
    same exactly for equal windows that may have an equal one.  ``held_anchors`` bounds what a task holds
    before it sends.  ``hot_here`` and ``hot_contexts`` are the contexts of a block, in one task and in one bucket,
    beyond which its windows are dealt one by one.  Very long texts are hashed in parts.
    """
    own = texts_of(known)
    buckets = buckets_for(known.sparkSession, characters(own))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []

        def flush() -> pd.DataFrame:
            rows = pack_anchors({k: np.concatenate([h[k] for h in held]) for k in held[0]}, buckets, hot_here)
            held.clear()
            return pd.DataFrame(rows, columns=["bucket", "kind", "ids", "counts", "lo", "n", "g", "c"])

        for pdf in slices(batches):
            ids = pdf["_id"].to_numpy()
            x, counts = codes(own_bytes(pdf["_text"]))
            for part, sizes, doc, offset in segments(x, counts, window):
                got = anchors(part, sizes, window, block)
                held.append({"id": ids[doc[got["doc"]]], "lo": got["lo"] + offset[got["doc"]], "n": got["n"], "g": got["g"], "c": got["c"]})
                if sum(len(h["id"]) for h in held) >= held_anchors:
                    yield flush()
        if held:
            yield flush()

    packed = own.mapInPandas(send, PACKED_ANCHORS)
    first = by_bucket(packed, buckets).applyInPandas(lambda pdf: settle_anchors(pdf, hot_contexts), "_id long, span long, ask boolean, g long, hot boolean")
    first = stage(first, "anchors")

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            texts = own_bytes(pdf["_text"])
            asked = np.array([len(s) for s in pdf["spans"]])
            spans, g = np.concatenate(pdf["spans"].tolist()), np.concatenate(pdf["gs"].tolist()).astype(np.uint64)
            hot = np.concatenate(pdf["hots"].tolist()).astype(bool)
            ids, lo, n = np.repeat(pdf["_id"].to_numpy(), asked), spans >> 16, spans & 0xFFFF
            rows, calm = [], np.flatnonzero(~hot)
            if len(calm):
                raw, of = [], np.repeat(np.arange(len(texts)), asked)[calm]
                for d in split_sorted(of):
                    piece = cutter(texts[of[d[0]]])
                    raw += [piece(a, a + k - 1 + window) for a, k in zip(lo[calm[d]].tolist(), n[calm[d]].tolist())]
                rows += pack_contexts(ids[calm], lo[calm], n[calm], g[calm], raw, buckets)
            if hot.any():
                x, counts = codes(texts)
                base = np.repeat(np.cumsum(counts) - counts, asked)
                s, at = np.flatnonzero(hot), 0
                while at < len(s):  # hash by stretches of about CHUNK tokens
                    p = base[s] + lo[s]
                    upto = max(at + 1, int(np.searchsorted(p, p[at] + CHUNK)))
                    t = s[at:upto]
                    of = np.repeat(t, n[t])
                    each = np.arange(len(of)) - np.repeat(np.cumsum(n[t]) - n[t], n[t])
                    q = base[of] + lo[of] + each
                    a, b = int(q.min()), int(q.max()) + window
                    rows += pack_hot(ids[of], lo[of] + each, g[of], Prefix(x[a:b]).hash(q - a, q - a + window), buckets)
                    at = upto
            yield pd.DataFrame(rows, columns=["bucket", "kind", "ids", "lo", "n", "g", "texts", "sizes"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [late_windows(pdf[pdf["kind"] == k], k, equal, window) for k in (0, 1)]
        done = pdf[pdf["kind"] == 2]
        i, a, size = (np.concatenate(x) for x in zip(*out))
        i, a, size = merged(np.repeat(i, size), np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum()))
        release()
        spans = [span(a, size), span(np.frombuffer(b"".join(done["lo"]), "<u4").astype(np.int64), np.frombuffer(b"".join(done["n"]), "<u2"))]
        return pd.DataFrame({"_id": np.concatenate([i, np.frombuffer(b"".join(done["ids"]), "<i8")]), "span": np.concatenate(spans)})

    # the spans that a document asks about stand in the order of its text
    wanted = first.filter("ask").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("span", "g", "hot"))).alias("q")).select("_id", F.col("q.span").alias("spans"), F.col("q.g").alias("gs"), F.col("q.hot").alias("hots"))
    second = by_bucket(own.join(wanted, "_id").mapInPandas(show, PACKED_CONTEXTS), buckets).applyInPandas(compare, "_id long, span long")
    every = first.filter("not ask").select("_id", "span").unionByName(second)
    return every.groupBy("_id").agg(F.collect_list("span").alias("_spans"))


def late_windows(pdf: pd.DataFrame, kind: int, equal: Callable, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, lo, n = 1) of the windows in one bucket that an equal one comes before."""
    ids, lo = np.frombuffer(b"".join(pdf["ids"]), "<i8"), np.frombuffer(b"".join(pdf["lo"]), "<u4").astype(np.int64)
    n, g = np.frombuffer(b"".join(pdf["n"]), "<u2").astype(np.int64), from6(b"".join(pdf["g"]))
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if kind == 1:  # hot: hashes of block and window
        w = from6(b"".join(pdf["texts"]))
        order = np.lexsort((w, g))
        group = np.empty(len(w), np.int64)
        group[order] = np.cumsum(runs(g[order], w[order]))
    else:
        ends = np.cumsum(np.frombuffer(b"".join(pdf["sizes"]), "<u4").astype(np.int64))
        raw = b"".join(pdf["texts"])
        group = equal([raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], n, g, window)
    # windows in the order of documents and places: runs are few, and windows follow in them
    run = np.argsort(np.lexsort((lo, ids)))
    of = np.repeat(np.arange(len(n)), n)
    place = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    there = np.flatnonzero(group >= 0)
    order = there[np.lexsort((place[there], run[of[there]], group[there]))]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    late = order[later_copies(order, runs(group[order]), ids[of], place)]
    return ids[of[late]], place[late], np.ones(len(late), np.int64)


def removed(spans, n_tokens: int, window: int) -> np.ndarray:
    """The maximal removed runs, as an array of (start, end) token positions."""
    if spans is None or not len(spans):
        return np.zeros((0, 2), np.int64)
    v = np.sort(np.asarray(spans, np.int64))
    lo, hi = v >> 16, np.minimum((v >> 16) + (v & 0xFFFF) - 1 + window, n_tokens)
    reach = np.maximum.accumulate(hi)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > reach[:-1]
    head = np.flatnonzero(new)
    got = np.stack([lo[head], reach[np.append(head[1:], len(lo)) - 1]], 1)
    return got[got[:, 0] < got[:, 1]]


def with_spans(known: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, _spans) of every row of ``known``; null where nothing repeats."""
    return known.join(spans, "_id", "left").select("row", "_spans")
